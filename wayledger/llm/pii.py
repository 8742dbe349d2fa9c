"""Problem 7: personal information inside free text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm import crf

#: Stands between the fields of a row, which are read as one document.
BREAK = "\n¶\n"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_NI = re.compile(r"[a-z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[a-z]", re.I)
_AT = re.compile(r"@[\w-]+\.\w|[(\[ ]at[)\] ]", re.I)
_STREET = re.compile(r"\d+[a-z]?,? +[a-z]{2}", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")


def plausible(kind: str, span: str) -> bool:
    """The exact check behind the field: what a span must have to be of its kind."""
    if kind == "email":
        return bool(_AT.search(span))
    digits = sum(ch.isdigit() or ch in "oO" for ch in span)
    if kind == "phone":
        return 9 <= digits <= 15
    if kind == "id_number":
        return bool(_NI.search(span)) or 9 <= digits <= 12
    if kind == "address":
        return bool(_STREET.search(span))
    return len(_WORD.findall(span)) >= 2


def load_model(path: str | None = None) -> tuple:
    """The parts of the trained field (features, weights, transitions, starts, label pairs over skip edges, common words)."""
    with np.load(path or Path(__file__).with_name("pii_model.npz")) as z:
        names = str(z["features"]).split("\n")
        return {f: i for i, f in enumerate(names)}, z["weights"].astype(np.float32), z["trans"], z["start"], z["skip"], frozenset(str(z["common"]).split("\n")), z["shapes"].astype(np.float32)


def find(model: crf.Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(from, to, kind) of the personal information in each text, as the field labels it and the exact check lets it stand."""
    out = []
    for t, y in zip(texts, model.label([crf.keys(t) for t in texts])):
        found: list[tuple[int, int, str]] = []
        if len(y):
            own = crf.tokenize(t)
            i, n = 0, len(y)
            while i < n:
                j = i + 1
                if y[i]:
                    while j < n and y[j] == y[i]:
                        j += 1
                    kind = crf.LABELS[y[i]]
                    found += [(a, b, kind) for a, b in _parts(t, own[i][0], own[j - 1][1]) if plausible(kind, t[a:b])]
                i = j
        out.append(found)
    return out


def _parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A span never reaches from one field into the next."""
    at = text.find(BREAK, a, b)
    return [(a, b)] if at < 0 else [(a, at), *_parts(text, at + len(BREAK), b)]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span."""
    out, last = [], 0
    for a, b, kind in sorted(found):
        if a >= last:
            out += [text[last:a], PLACEHOLDER[kind]]
            last = b
    return "".join(out) + text[last:]


_models: dict[str, crf.Model] = {}


def personal_information(df: DataFrame, key: str, fields: list[str], redacted: bool = False) -> DataFrame:
    """One row (key, field_name, kind) for each row, field and kind found in it at least once; with redacted, df's key and
    fields with placeholders instead.

    The fields of a row are read as one document, so that a name in one helps to find it in the other. Null and empty
    fields hold nothing and stay as they are; texts of any length are read whole; repeated rows give repeated results. No
    shuffle: the field, which is small and fixed, goes to every task, where documents are labelled batch by batch.
    """
    parts = load_model()
    mark = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in parts[1:5])).hexdigest()
    held = df.sparkSession.sparkContext.broadcast(parts)
    schema = pa.schema([(f, pa.string()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get(mark)  # a worker that is used again keeps its model, as long as it is the same one
        if model is None:
            _models.clear()
            model = _models[mark] = crf.Model(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                columns = [part[f].to_pylist() for f in fields]
                keys, names, kinds = [], [], []
                changed = [list(c) for c in columns]
                docs = [BREAK.join(x or "" for x in row) for row in zip(*columns)]
                for i, found in enumerate(find(model, docs)):
                    if not found:
                        continue
                    first = 0
                    for k, f in enumerate(fields):
                        text = columns[k][i] or ""
                        own = [(a - first, e - first, kind) for a, e, kind in found if first <= a and e <= first + len(text)]
                        first += len(text) + len(BREAK)
                        if own and redacted:
                            changed[k][i] = redact(text, own)
                        elif own:
                            for kind in sorted({x[2] for x in own}):
                                keys.append(i)
                                names.append(f)
                                kinds.append(kind)
                if redacted:
                    yield pa.RecordBatch.from_arrays([part["key"], *(pa.array(c, type=pa.string()) for c in changed)], ["key", *schema.names])
                else:
                    yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(keys, type=pa.int64())), pa.array(names, type=pa.string()), pa.array(kinds, type=pa.string())], ["key", "field_name", "kind"])

    kind = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("key"), *fields)
    if redacted:
        return source.mapInArrow(run, f"key {kind}, " + ", ".join(f"`{f}` string" for f in fields)).withColumnRenamed("key", key)
    return source.mapInArrow(run, f"key {kind}, field_name string, kind string").withColumnRenamed("key", key)
