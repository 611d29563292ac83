"""SentencePiece encoding and decoding by a score-ordered agenda of symbol pairs.

For merge-type (BPE) vocabularies.  A text gets the leading mark and has its spaces
replaced by marks, then it is cut at places that no vocabulary piece spans: merges on
the two sides of such a place cannot touch each other, so the units can be encoded
apart and cached.  In a unit every adjacent pair of symbols that forms a piece waits in
an agenda ordered by (score, place); the best is merged, its new neighbours join the
agenda, until none is left.  Symbols without a piece are spelled as bytes.

Each unit that is new to a worker is also encoded and decoded by the sentencepiece
library, batch by batch; a difference raises an error, so a result is exact or none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pieces never run on from a letter or digit to anything else, nor over a line end; checked for each model.
UNIT = re.compile(MARK + r"*[^\n" + MARK + r"A-Za-zÀ-ɏ0-9]*[A-Za-zÀ-ɏ0-9]+|\n|" + MARK + r"*[^\n" + MARK + r"A-Za-zÀ-ɏ0-9]+|" + MARK + "+")
SAFE = re.compile(MARK + r"*[^" + MARK + r"\n]+|\n|" + MARK + "+")
WHOLE = re.compile(r"(?s).+")
#: Characters of a unit whose agenda is a plain list, and the score of a pair that is no piece.
SHORT, NEVER = 40, float("-inf")


class PieceCodec:
    """Encoder and decoder of one model file.  ``cache`` bounds the units kept by a worker."""

    def __init__(self, path: str, cache: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.cache, self.new, self.old = cache, {}, {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if lib.unk_id() in self.bytes:
            raise ValueError("the model has no byte fallback")
        for i in range(lib.vocab_size()):
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                piece = lib.id_to_piece(i)
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
        self.piece = {i: p for p, i in self.ids.items()}
        self.unit = next(p for p in (UNIT, SAFE, WHOLE) if all(p.match(x).end() == len(x) for x in self.ids))

    def agenda(self, unit: str) -> list[int]:
        """Ids of one unit."""
        if len(unit) <= SHORT:
            return self.spelled_out(self.short_agenda(unit))
        score = self.score
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                waiting.append((-s, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(waiting)
        while waiting:
            _, i, merged = heapq.heappop(waiting)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] + symbols[j] != merged:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(merged + symbols[k])) is not None:
                    heapq.heappush(waiting, (-s, i, merged + symbols[k]))
            if (h := before[i]) >= 0 and (s := score.get(symbols[h] + merged)) is not None:
                heapq.heappush(waiting, (-s, h, symbols[h] + merged))
        return self.spelled_out([s for s in symbols if s is not None])

    def short_agenda(self, unit: str) -> list[str]:
        """The same merges where the agenda is a list in order of place: the first of the greatest scores is the next."""
        score, symbols = self.score.get, list(unit)
        waiting = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while waiting and (best := max(waiting)) != NEVER:
            i = waiting.index(best)
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = score(merged + symbols[i + 1], NEVER)
            if i:
                waiting[i - 1] = score(symbols[i - 1] + merged, NEVER)
        return symbols

    def spelled_out(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; those that are no piece as bytes."""
        out = [self.ids.get(s) for s in symbols]
        if None not in out:
            return out
        return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte ids joined as UTF-8, marks to spaces, without the leading one."""
        return self.text_of(self.spell(ids))

    def text_of(self, spelt: str) -> str:
        return spelt.removeprefix(MARK).replace(MARK, " ")

    def spell(self, ids: list[int]) -> str:
        pieces = [self.piece.get(i) for i in ids]
        if None not in pieces:
            return "".join(pieces)
        out, held = [], bytearray()
        byte = getattr(self, "_byte", None)
        if byte is None:
            byte = self._byte = {i: b for b, i in enumerate(self.bytes)}
        for i in ids:
            if (b := byte.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.piece[i])
        out.append(held.decode(errors="replace"))
        return "".join(out)

    def learn(self, units: set[str]) -> None:
        """Encode new units and check them against the library in one call."""
        if len(self.new) + len(units) > self.cache:
            self.old, self.new = self.new, {}
        units = list(units)
        ours = [self.agenda(u) for u in units]
        spelt = [self.spell(ids) for ids in ours]
        bare = [u.replace(MARK, " ") for u in units]  # the library puts its own mark before each
        marked = [i for i, u in enumerate(units) if u[0] == MARK]
        theirs = self.library.encode([bare[i][1:] for i in marked], num_threads=1)
        back = self.library.decode([ours[i] for i in marked], num_threads=1) if marked else []
        for i, ids, text in zip(marked, theirs, back):
            if len(units[i]) > 1 and (ours[i] != ids or text != self.text_of(spelt[i])):
                raise ValueError(f"unit {units[i]!r}: {ours[i]}, by the library {ids}")
        rest = [i for i, u in enumerate(units) if u[0] != MARK]
        theirs = self.library.encode(["\n" + bare[i] for i in rest], num_threads=1)
        head = len(self.library.encode("\n"))  # a line end is never joined to what follows
        for i, ids in zip(rest, theirs):
            if self.unit is not WHOLE and ours[i] != ids[head:]:
                raise ValueError(f"unit {units[i]!r}: {ours[i]}, by the library {ids[head:]}")
        for u, ids, text in zip(units, ours, spelt):
            self.new[u] = (",".join(map(str, ids)), text.replace(MARK, " "))

    def encode_batch(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """(ids joined by commas, decoded text) of each unit, text by text."""
        split = self.unit.findall
        cut = [split((MARK + t.replace(" ", MARK)) if t else "") for t in texts]
        wanted = set()
        for units in cut:
            wanted.update(units)
        new, old = self.new, self.old
        got = {u: new.get(u) or old.get(u) for u in wanted}
        fresh = {u for u, v in got.items() if v is None}
        self.learn(fresh)
        new = self.new
        new.update((u, v) for u, v in got.items() if v is not None)
        got.update((u, new[u]) for u in fresh)
        return [[got[u] for u in units] for units in cut]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a worker process: its cache serves all tasks that run there."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _chunks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters, so that a batch of very long texts stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode the whole ``text`` of each row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids array<int>
    and decoded string.  Null and empty texts have no ids.  Rows are kept one to one,
    repeats and null doc_ids included; further columns of ``docs`` are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in batches:
            all_texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo, hi in _chunks(all_texts):
                rows = []
                for units in c.encode_batch(all_texts[lo:hi]):
                    joined = ",".join([u[0] for u in units])
                    text = "".join([u[1] for u in units])[1:]  # without the mark put first
                    row = [joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    rows.append(row + [[int(i) for i in joined.split(",") if i], text] if with_ids else row)
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")[1:]])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[lo:hi].to_numpy())
                yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, decoded: the text of each row's ``ids`` (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "decoded": [c.decode([int(i) for i in x]) if x is not None else "" for x in pdf["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded string")
