"""Free-text entity detection with an injected model: hints, offsets, and batches of one set of labels."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.operators.policy import SPAN, spans_of

#: Fields of ``SPAN``.
_SPAN = {"text": pa.string(), "label": pa.string(), "start": pa.int32(), "end": pa.int32(), "score": pa.float64()}
_money = re.compile(K.MONEY_SHAPE, re.I)


class Hinted:
    """A text with a hint after each amount of money that names no unit, and the way back to its own offsets."""

    def __init__(self, text: str, hint: str = K.MONEY_HINT):
        self.original = text
        at = [m.end() for m in _money.finditer(text) if not m[0][-1].isalpha()]
        self.hint = len(hint)
        self.after = [end + (k + 1) * len(hint) for k, end in enumerate(at)]  # where each hint ends in the new text
        self.text = "".join(text[a:b] + hint for a, b in zip([0, *at], at)) + text[at[-1] if at else 0 :]

    def back(self, place: int) -> int:
        """The place in the original of a place in the new text."""
        return min(max(place - self.hint * bisect_right(self.after, place), 0), len(self.original))

    def span(self, found: dict) -> dict:
        """``found`` (offsets in the new text) with offsets and words of the original."""
        start = self.back(int(found["start"]))
        end = max(start, self.back(int(found["end"])))
        return found | {"start": start, "end": end, "text": self.original[start:end]}


def _asked(rows: DataFrame, allowed: list[str], request: str | None) -> DataFrame:
    """``rows`` with ``_asked``: their labels as far as allowed; those of all rows together where a request has more than four sets."""
    own = F.array_sort(F.array_distinct(F.array_intersect("labels", F.array(*map(F.lit, allowed)).cast("array<string>"))))
    rows = rows.withColumn("_asked", F.coalesce(own, F.array().cast("array<string>")))
    sets = rows.select(*([request] if request else []), "_asked").distinct()
    if not request:
        if len(sets.limit(K.LABEL_SETS + 1).collect()) <= K.LABEL_SETS:
            return rows
        every = sorted(r[0] for r in sets.select(F.explode("_asked")).distinct().collect())  # at most the allowed ones
        return rows.withColumn("_asked", F.array(*map(F.lit, every)))
    many = sets.groupBy(request).agg(F.count("*").alias("_sets"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_asked")))).alias("_every"))
    j = rows.join(many.where(F.col("_sets") > K.LABEL_SETS), request, "left")
    return j.withColumn("_asked", F.coalesce("_every", "_asked")).drop("_sets", "_every")


def detect_entities(rows: DataFrame, labels: list[str], detect: Callable[[list[str], list[str]], list[list[dict]]] | None = None, threshold: float = 0.3, batch: int = 64, request: str | None = None) -> DataFrame:
    """id, entities of each row (id, text): patterns for ``labels``, then what ``detect(texts, labels)`` finds.

    ``detect`` gets up to ``batch`` texts and the labels in words (``employee salary`` for
    ``employee_salary``), and gives for each text dictionaries of text, label, start, end, score.
    Texts go to it with a hint after each bare amount of money; spans come back on the original.
    Of what it gives, labels not asked for and scores below ``threshold`` are left out.

    Rows may have ``labels`` of their own (array): the model is then asked for these alone, as far as
    they are in ``labels``, one call for texts of one set.  Where the rows of a ``request`` (a column; none:
    all rows) have more than four sets, all of them are asked for the union.  Null and empty texts
    have no entities; an error of the model ends the job rather than pass for "nothing found".
    """
    allowed = sorted(set(labels))
    own = "labels" in rows.columns
    asked = _asked(rows, allowed, request) if own and detect else rows.withColumn("_asked", F.array(*map(F.lit, allowed)).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column("text").to_pylist()]
            found = [spans_of(t, set(allowed)) for t in texts]
            sets: dict[tuple, list[int]] = {}
            for i, wanted in enumerate(rows.column("_asked").to_pylist()):
                if detect and texts[i] and len(wanted):
                    sets.setdefault(tuple(wanted), []).append(i)
            for wanted, members in sets.items():
                spoken = {w.replace("_", " "): w for w in wanted}
                for lo in range(0, len(members), batch):
                    some = members[lo : lo + batch]
                    hinted = [Hinted(texts[i]) for i in some]
                    for i, h, got in zip(some, hinted, detect([h.text for h in hinted], list(spoken))):
                        found[i] += [h.span(e | {"label": spoken[e["label"]]}) for e in got if e["label"] in spoken and e["score"] >= threshold]
            flat = [e for entities in found for e in entities]
            spans = pa.StructArray.from_arrays([pa.array([e[k] for e in flat], kind) for k, kind in _SPAN.items()], list(_SPAN))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(ends, spans)], ["id", "entities"])

    return asked.select(F.col("id").cast("long"), F.col("text").cast("string"), "_asked").mapInArrow(run, f"id long, entities {SPAN}")


def entity_summary(entities: Column, text: Column) -> Column:
    """struct<entity_types, flags>: the labels found, and the flags these and the words of the text raise, both sorted."""
    types = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["label"])))
    by_label = F.create_map(*[x for k, v in K.ENTITY_FLAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of_labels = F.flatten(F.transform(types, lambda t: F.coalesce(by_label[t], F.array().cast("array<string>"))))
    of_words = F.filter(F.array(*[F.when(text.rlike("(?iu)" + K.FLAG_PATTERNS[f]), F.lit(f)) for f in K.FLAG_WORDS]), lambda f: f.isNotNull())
    return F.struct(types.alias("entity_types"), F.array_sort(F.array_distinct(F.concat(of_labels, of_words))).alias("flags"))


def query_entities(questions: DataFrame, labels: list[str], detect: Callable | None = None) -> DataFrame:
    """``questions`` (id, text; ids are unique) with labels, a sorted array: the entity types that each question is about.

    A label is found by the detector (``detect_entities``), by one of its aliases in the text, or by a word of its own name
    there, all without regard to case and anywhere in the text.  Labels are those given (``rule_keys``) and those with aliases.
    """
    known = sorted({*labels, *K.LABEL_ALIASES})
    words = [(x, sorted({*K.LABEL_ALIASES.get(x, []), *(w for w in x.split("_") if w)})) for x in known]
    book = F.from_json(F.lit(json.dumps([{"label": x, "words": ws} for x, ws in words])), "array<struct<label:string,words:array<string>>>")
    lower = F.lower(F.coalesce("text", F.lit("")))
    named = F.transform(F.filter(book, lambda x: F.exists(x["words"], lambda w: F.contains(lower, w))), lambda x: x["label"])
    found = detect_entities(questions, labels, detect).select("id", F.transform("entities", lambda e: e["label"]).alias("_found"))
    return questions.join(found, "id", "left").withColumn("labels", F.array_sort(F.array_distinct(F.concat(F.coalesce("_found", F.array().cast("array<string>")), named)))).drop("_found")
