"""Training-data operators at corpus scale.  Nothing outside this subpackage imports it."""
