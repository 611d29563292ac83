"""Part of rolesieve."""
