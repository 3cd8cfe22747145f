"""Fill-in-the-middle transformation: numpy kernels over whole Arrow batches of UTF-8.

Every byte gets a class from a table of 256; a mask over neighbouring classes
says where a unit (line, word or code point) starts; running sums of the mask,
set back at each document, count units; and one binary search in them finds the
cuts of all rows. The output is gathered segment by segment for the whole batch,
and a second kernel rebuilds the texts from outputs and forms alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import free_name, read_table

SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SLICE_BYTES = 4 << 20  # a kernel gets so many bytes of text, but a row at least

OTHER, NEWLINE, BLANK, TAIL = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[10], CLASS[[9, 11, 12, 13, 32]], CLASS[0x80:0xC0] = NEWLINE, BLANK, TAIL  # TAIL: bytes within a code point


def _starts(rule) -> np.ndarray:
    return np.array([[rule(before, here) for here in range(4)] for before in range(4)])


#: For each kind of unit: does one start at a byte, by the classes of the byte before and of its own?
STARTS = {
    "line": _starts(lambda before, here: before == NEWLINE),
    "word": _starts(lambda before, here: before in (NEWLINE, BLANK) and here not in (NEWLINE, BLANK)),  # a word and the white space behind it
    "char": _starts(lambda before, here: here != TAIL),
}


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels that could not be told from text beside them, that is,
    if one holds another or one's end is another's beginning."""
    if len(sentinels) != 3 or not all(sentinels) or len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} and {b!r} overlap")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its rows' offsets."""
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column from bytes and offsets; rows that are not valid are null."""
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
    return out if valid is None or valid.all() else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.string()))


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of SLICE_BYTES of text at most, one row at least."""
    _, offsets = utf8(batch.column(text_col))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def count_units(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running number of units begun up to each byte, units begun before each row, units of each row)."""
    kinds = CLASS[data]
    start = np.zeros(len(data), bool)
    start[1:] = STARTS[unit][kinds[:-1], kinds[1:]]
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    running = np.cumsum(start, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at = np.concatenate([[0], running])[offsets]
    return running, at[:-1], np.diff(at)


def cut_places(running: np.ndarray, before: np.ndarray, offsets: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte at which each row's unit number k (from 0) starts, or the row's end if it has only k."""
    return np.minimum(np.searchsorted(running, before + k + 1), offsets[1:])


def gather(data: np.ndarray, segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of rows that are each made of these segments (starts, lengths) of data."""
    begin, size = (np.stack(x, axis=1).ravel() for x in zip(*segments))
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and len(data) < 1 << 31 else np.int64
    where = np.repeat((begin - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)
    return data[where], np.concatenate([[0], ends[len(segments) - 1 :: len(segments)]])


def transform_rows(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, suffix_first: np.ndarray, h1: np.ndarray, h2: np.ndarray, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "line"):
    """(n, prefix_chars, middle_chars, output bytes, output offsets) of all rows of a batch."""
    running, before, n = count_units(data, offsets, unit)
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = (cut_places(running, before, offsets, k) for k in (np.minimum(a, b), np.maximum(a, b)))
    begin, end = offsets[:-1], offsets[1:]
    code_points = np.concatenate([[0], np.cumsum(CLASS[data] != TAIL)])
    marks = [np.frombuffer(s.encode(), np.uint8) for s in sentinels]
    mark_at = len(data) + np.cumsum([0, *map(len, marks)])
    p, s, m = ((np.full(len(n), mark_at[i]), np.where(plain, 0, len(marks[i]))) for i in range(3))
    prefix, middle, suffix = (begin, first - begin), (first, second - first), (second, end - second)
    # plain: the pieces in their own order, and no marks
    pick = lambda psm, spm, own: tuple(np.where(plain, own[i], np.where(suffix_first, spm[i], psm[i])) for i in (0, 1))
    segments = [pick(p, s, p), pick(prefix, suffix, prefix), pick(s, p, s), pick(suffix, prefix, middle), m, pick(middle, middle, suffix)]
    out, out_offsets = gather(np.concatenate([data, *marks]), segments)
    return n, code_points[first] - code_points[begin], code_points[second] - code_points[first], out, out_offsets


def first_places(data: np.ndarray, offsets: np.ndarray, token: str) -> np.ndarray:
    """Where each row first holds the token; -1 where it does not."""
    sign = np.frombuffer(token.encode(), np.uint8)
    at = np.flatnonzero(data[: max(0, len(data) - len(sign) + 1)] == sign[0])
    for i in range(1, len(sign)):
        at = at[data[at + i] == sign[i]]
    row = np.searchsorted(offsets, at, "right") - 1
    within = at + len(sign) <= offsets[row + 1]
    rows, index = np.unique(row[within], return_index=True)
    out = np.full(len(offsets) - 1, -1)
    out[rows] = at[within][index]
    return out


def restore_rows(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, suffix_first: np.ndarray, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, whole) of the texts behind outputs; whole is false where a sentinel is missing or out of order."""
    p, s, m = (first_places(data, offsets, t) for t in sentinels)
    lp, ls, lm = (len(t.encode()) for t in sentinels)
    lead, second, end = np.where(suffix_first, s, p), np.where(suffix_first, p, s), offsets[1:]
    whole = plain | ((lead == offsets[:-1]) & (second > lead) & (m > second))
    prefix = (p + lp, np.where(suffix_first, m, s) - p - lp)
    middle = (m + lm, end - m - lm)
    suffix = (s + ls, np.where(suffix_first, p, m) - s - ls)
    zero = np.zeros(len(p), np.int64)
    segments = [(np.where(whole & ~plain, x[0], offsets[:-1]), np.where(whole & ~plain, x[1], y)) for x, y in ((prefix, np.where(plain, np.diff(offsets), 0)), (middle, zero), (suffix, zero))]
    return *gather(data, segments), whole


def fill_in_middle(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = "line",
    sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    n: the text's units; unit is "line", "word" or "char". Two cuts and the form
    follow from sha256 of seed and id alone, so reruns agree under any
    partitioning. form: "plain" (output is the text), "psm" (prefix, suffix,
    middle, each behind its sentinel) or "spm" (suffix, prefix, middle). Plain
    are empty texts, those that hold a sentinel, and 100 - fim_percent of the
    rest. A null text counts as empty, a null id as an empty string; repeated
    rows are treated alike; an empty table gives an empty one; other columns are
    not read. Texts of any length are cut as a whole.
    """
    check_sentinels(sentinels)
    if unit not in STARTS:
        raise ValueError(f"unit must be one of {', '.join(STARTS)}")
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = (F.col("text") == "") | (h[2] % 100 >= fim_percent)
    for s in sentinels:
        plain |= F.contains(F.col("text"), F.lit(s))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                data, offsets = utf8(b.column("text"))
                form = b.column("form").to_numpy(zero_copy_only=False)
                plain = form == "plain"
                n, prefix, middle, out, out_offsets = transform_rows(data, offsets, plain, form == "spm", b.column("h1").to_numpy(), b.column("h2").to_numpy(), sentinels, unit)
                columns = [b.column("doc_id"), pa.array(n, pa.int64()), b.column("form"), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), strings(out, out_offsets)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return shipped(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(coded: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """coded with the text that each output was made of, from output and form alone.

    Null where output or form is null, or where the form's sentinels are not in
    the output in its order. If the name `to` is taken, _ is put in front.
    """
    check_sentinels(sentinels)
    to = free_name(to, coded.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output = pa.compute.fill_null(batch.column(output_col), "")
            known = pa.compute.and_(batch.column(output_col).is_valid(), batch.column(form_col).is_valid())
            given = pa.RecordBatch.from_arrays([*batch.columns, output, known], [*batch.schema.names, "", " "])
            for b in slices(given, ""):
                data, offsets = utf8(b.column(""))
                form = b.column(form_col).to_numpy(zero_copy_only=False)
                out, out_offsets, whole = restore_rows(data, offsets, form == "plain", form == "spm", sentinels)
                valid = whole & b.column(" ").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], strings(out, out_offsets, valid)], [*batch.schema.names, to])

    return shipped(coded).mapInArrow(run, f"{schema}, `{to}` string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(read_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
), hashed AS (
    SELECT doc_id, t, u, len(u) AS n, CAST('0x' || digest[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || digest[9:16] AS BIGINT) % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
            WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), cut AS (
    SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix,
        coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix
    FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut
"""
}
