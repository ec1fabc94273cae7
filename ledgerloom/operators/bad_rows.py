"""Rows that fail to parse, set apart with the reason while the others load.

Method: blocks of records of one format are parsed on a columnar path. One vectorised pattern tells which records have
the form of the run, those are read in bulk by the Arrow CSV reader, and the checks of name, email and phone are masks over
the columns read. A block that the reader refuses is bisected, recursively, until single records are isolated. Isolated
records, those without the form, and those with characters on which the pattern engines differ are diagnosed by a strict
character-level reader.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame

from ledgerloom.session import salted_join

FIELDS = ("name", "email", "phone")
EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
EXTENSION = r"(?i)[\s,;]*(ext|x)\.?:?\s*\d+$"
PHONE_CHARS = r"^[0-9+().\-/\s]*$"
SCHEMA = "run_id string, line_no int, reason string, name string, email string, phone string, fields array<string>"
BLOCK = 4096
#: Columns up to which the form of a record is told by one pattern; wider records are read strictly.
MAX_WIDTH = 900
MAX_BLOCK_BYTES = 16 << 20


def strict_fields(raw: str, sep: str) -> list[str] | None:
    """The fields of one record, or None where the quoting is broken.

    A double quote may only open a field as its first character; inside, quotes are doubled; the closing one ends it.
    """
    fields, i, n, w = [], 0, len(raw), len(sep)
    while True:
        if raw[i:i + 1] == '"':
            part, i = [], i + 1
            while True:
                j = raw.find('"', i)
                if j < 0:
                    return None
                part.append(raw[i:j])
                if raw[j + 1:j + 2] == '"':
                    part.append('"')
                    i = j + 2
                else:
                    i = j + 1
                    break
            if i < n and not raw.startswith(sep, i):
                return None
            fields.append("".join(part))
        else:
            j = raw.find(sep, i)
            end = n if j < 0 else j
            if '"' in raw[i:end]:
                return None
            fields.append(raw[i:end])
            i = end
        if i >= n:
            return fields
        i += w


def phone_ok(value: str) -> bool:
    main = re.sub(EXTENSION, "", value.strip())
    return bool(re.match(PHONE_CHARS, main)) and 8 <= sum(c.isdigit() for c in main) <= 15


def diagnose(raw: str, sep: str, width: int, at: dict[str, int]) -> tuple[str | None, list[str] | None]:
    """First reason that applies, or None, and the fields."""
    fields = strict_fields(raw, sep)
    if fields is None:
        return "broken_quoting", None
    if len(fields) != width:
        return "column_count", fields
    value = {k: fields[i] for k, i in at.items()}
    if not any(c.isalpha() for c in value.get("name", "")):
        return "missing_name", fields
    email, phone = value.get("email", "").strip(), value.get("phone", "").strip()
    if email and not re.match(EMAIL, email):
        return "invalid_email", fields
    if phone and not phone_ok(phone):
        return "invalid_phone", fields
    return None, fields


def _formed(raw: pa.Array, sep: str, width: int) -> np.ndarray:
    """Which records have whole quoting and the run's number of fields."""
    if len(sep) != 1 or sep in '"\r\n' or ord(sep) > 127 or not 0 < width <= MAX_WIDTH:
        return np.zeros(len(raw), dtype=bool)
    s = re.escape(sep)
    field = rf'(?:"(?:[^"]|"")*"|[^"{s}][^"{s}]*|)'
    good = pc.match_substring_regex(raw, rf"^(?s:{field}(?:{s}{field}){{{width - 1}}})$")
    return pc.and_(good, pc.greater(pc.utf8_length(raw), 0)).to_numpy(zero_copy_only=False)


def _read(records: list[str], sep: str, width: int) -> list[pa.Array] | None:
    """The columns of a block of well-formed records, or None where the reader refuses it."""
    try:
        data = "\n".join(records).encode()
        got = pcsv.read_csv(
            io.BytesIO(data), pcsv.ReadOptions(column_names=[str(i) for i in range(width)], block_size=max(len(data) + 1, 1024), use_threads=False),
            pcsv.ParseOptions(delimiter=sep, newlines_in_values=True, ignore_empty_lines=False),
            pcsv.ConvertOptions(column_types={str(i): pa.string() for i in range(width)}, strings_can_be_null=False))
    except (pa.ArrowInvalid, UnicodeEncodeError):
        return None
    return [got.column(i).combine_chunks() for i in range(width)] if got.num_rows == len(records) else None


def _reasons(columns: list[pa.Array], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(first reason or None, whether to read strictly) of each record of a block, by masks over its columns."""
    n = len(columns[0])
    mask = lambda m: m.to_numpy(zero_copy_only=False)
    reason, strict = np.full(n, None, dtype=object), np.zeros(n, dtype=bool)
    reason[~mask(pc.match_substring_regex(columns[at["name"]], r"\p{L}")) if "name" in at else np.ones(n, dtype=bool)] = "missing_name"
    if "email" in at:
        x = pc.utf8_trim_whitespace(columns[at["email"]])
        strict |= mask(pc.match_substring_regex(x, r"[^\x20-\x7e]"))
        bad = ~mask(pc.or_(pc.equal(x, ""), pc.match_substring_regex(x, EMAIL)))
        reason[bad & (reason == None)] = "invalid_email"  # noqa: E711
    if "phone" in at:
        x = pc.utf8_trim_whitespace(columns[at["phone"]])
        strict |= mask(pc.match_substring_regex(x, r"[^\x20-\x7e]"))
        main = pc.replace_substring_regex(x, EXTENSION, "")
        digits = pc.utf8_length(pc.replace_substring_regex(main, r"[^0-9]", ""))
        good = pc.and_(pc.match_substring_regex(main, PHONE_CHARS), pc.and_(pc.greater_equal(digits, 8), pc.less_equal(digits, 15)))
        reason[~mask(pc.or_(pc.equal(x, ""), good)) & (reason == None)] = "invalid_phone"  # noqa: E711
    return reason, strict


def parse_block(records: list[str], sep: str, width: int, at: dict[str, int], strictly: list[int] | None = None) -> list[tuple[str | None, list[str] | None]]:
    """Reason (None: loads) and fields of each record. ``strictly`` gets the places of the records read strictly."""
    out: list = [None] * len(records)
    formed = _formed(pa.array(records, pa.string()), sep, width)
    alone = np.nonzero(~formed)[0].tolist()
    todo = [np.nonzero(formed)[0]]
    while todo:
        part = todo.pop()
        columns = _read([records[i] for i in part], sep, width) if len(part) else None
        if columns is not None:
            reason, strict = _reasons(columns, at)
            for i, why, unsure, *fields in zip(part.tolist(), reason, strict, *[c.to_pylist() for c in columns]):
                if unsure:
                    alone.append(i)
                else:
                    out[i] = (why, fields)
        elif len(part) == 1:
            alone += part.tolist()
        elif len(part):
            todo += np.array_split(part, 2)
    for i in alone:
        out[i] = diagnose(records[i], sep, width, at)
    if strictly is not None:
        strictly += alone
    return out


def _format(sep: str | None, header: str | None, mapping: str | None) -> tuple[str, int, dict[str, int]] | None:
    if not isinstance(sep, str) or not sep or not isinstance(header, str):
        return None
    names = header.split(sep)
    try:
        columns = json.loads(mapping or "{}").get("columns", {})
    except (ValueError, AttributeError):
        columns = {}
    return sep, len(names), {k: names.index(columns[k]) for k in FIELDS if columns.get(k) in names}


def _blocks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    start, size = 0, 0
    for i, n in enumerate(rows["raw_record"].str.len()):
        if i > start and (i - start >= BLOCK or size + n > MAX_BLOCK_BYTES):
            yield rows.iloc[start:i]
            start, size = i, 0
        size += n
    if start < len(rows):
        yield rows.iloc[start:]


def _parse_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        df = df.assign(raw_record=df["raw_record"].fillna(""))
        for _, same in df.groupby(["field_sep", "header_line", "mapping"], dropna=False, sort=False):
            first = same.iloc[0]
            how = _format(first["field_sep"], first["header_line"], first["mapping"])
            for part in _blocks(same):
                records = part["raw_record"].tolist()
                if how is None:
                    got = [("unknown_format", None)] * len(records)
                    at: dict[str, int] = {}
                else:
                    sep, width, at = how
                    got = parse_block(records, sep, width, at)
                value = lambda f, k: f[at[k]] if f is not None and k in at and at[k] < len(f) else None
                yield pd.DataFrame({
                    "run_id": part["run_id"].tolist(), "line_no": part["line_no"].astype("Int32").tolist(),
                    "reason": [r for r, _ in got],
                    **{k: [value(f, k) for _, f in got] for k in FIELDS},
                    "fields": [f for _, f in got]})


def parse_records(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Every distinct record with its fields and, where it fails, the first reason.

    ``records``: run_id, line_no, raw_record; ``runs``: run_id, field_sep, header_line, mapping. Reasons in order:
    broken_quoting, column_count, missing_name, invalid_email, invalid_phone; ``unknown_format`` where the run is missing
    or has no separator or header. A null record reads as an empty one. Exact duplicates count once; other columns are
    ignored. A run with any share of the records is no bottleneck: records stay in the partitions they were read in or,
    if the runs are too large to broadcast, are salted.
    """
    rows = records.select("run_id", "line_no", "raw_record").distinct()
    formats = runs.select("run_id", "field_sep", "header_line", "mapping").where("run_id is not null").dropDuplicates(["run_id"])
    return salted_join(rows, formats, "run_id").mapInPandas(_parse_frames, SCHEMA)
