"""Repeated substrings across documents by blockwise suffix sorting over a cover sample.

The cover is chosen by content: of each run of ``length`` bytes, the place of its smallest gram
hash is a sample (a string synchronising set). Like the places of a difference cover, equal runs
hold a sample at the same distance from their start, so all suffixes are placed by the samples:
a suffix that starts before a sample is told by the bytes up to it and the rank of the sample.
(A positional difference cover has this property too, but samples three times as many places.)

First a pre-filter by fingerprints: samples are dealt to buckets by gram hash; those whose gram is
in one document only drop out, and those that have the gram and the 64-bit hash of the
surroundings (80 bytes) of a sample in a smaller document are copies of it. What is left, one
sample for each different surrounding, is sorted by its real bytes, one bucket of grams at a time:
as suffixes, with the longest common prefixes of neighbours, and backwards as prefixes. The ranks
so found resolve all ``length - GRAM + 1`` suffixes around a sample without comparing them again:
two of them agree if their samples' ranks lie in one stretch of common prefixes long enough, on
either side. So the memory of a task is that of its bucket, and long ties cost nothing beyond the sort.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import bounded, delete_written, give_back, quoted, release, slices, utf8_bytes, written

GRAM = 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Text bytes for each bucket; a bucket has a sample for about every 16 of them.
BUCKET_BYTES = 48_000_000
STEP_BYTES = 700_000
RECORD = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<i4")])
#: A gram with more different surroundings than this is compared run by run, over all tasks.
HOT = 20_000


def _pack(x: np.ndarray) -> bytes:
    """Column after column: ids and places compress well so."""
    return b"".join(np.ascontiguousarray(x[c]).tobytes() for c in RECORD.names)


def _unpack(blobs: list[bytes]) -> np.ndarray:
    sizes = [len(b) // RECORD.itemsize for b in blobs]
    out, done = np.empty(sum(sizes), RECORD), 0
    for blob, n in zip(blobs, sizes):
        at = 0
        for c in RECORD.names:
            kind = RECORD[c]
            out[c][done : done + n] = np.frombuffer(blob, kind, n, at)
            at += n * kind.itemsize
        done += n
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place; the last places see zeros behind the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    load = lambda at, kind: np.ndarray((n,), kind, padded, at, (1,)).copy()
    with np.errstate(over="ignore"):
        x = load(0, "<u8") * _M1
        x = (x ^ (x >> np.uint64(31))) + load(8, "<u8") * _M2
        x = (x ^ (x >> np.uint64(29))) * _M1 + load(16, "<u4") * _M3
        return _stir(x)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` values (the result is shorter by width - 1)."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return x if done == width else pick(x[: len(x) - (width - done)], x[width - done :])


def cover_samples(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the samples of all texts in ``data``."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    key = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 stands for no run
    width = length - GRAM + 1
    low = _slide(key[: n - GRAM + 1], width, np.minimum)  # of the run that starts here
    valid = np.zeros(len(low) + 1, np.int32)  # runs inside of one text
    sizes = np.diff(borders)
    fit = sizes >= length
    np.add.at(valid, borders[:-1][fit], 1)
    np.add.at(valid, borders[1:][fit] - length + 1, -1)
    low = np.where(np.cumsum(valid[:-1]) > 0, low, 0)
    # a place is a sample if it is the smallest of some run with it
    edge = np.zeros(width - 1, np.uint32)
    most = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    places = np.flatnonzero((most == key[: len(most)]) & (most > 0))
    return places, h[places]


def surroundings(data: np.ndarray, borders: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, last): all runs of ``length`` with the gram at ``places`` lie in
    ``data[first:last]``; ``bytes`` has them in a row each, zeros where the text has ended."""
    text = np.searchsorted(borders, places, "right") - 1
    before = length - GRAM
    wide = before + length
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[places]
    first = np.maximum(places - before, borders[text])
    last = np.minimum(places + length, borders[text + 1])
    cut = np.flatnonzero((first > places - before) | (last < places + length))
    column = np.arange(wide)
    inside = (column >= (first - places + before)[cut, None]) & (column < (last - places + before)[cut, None])
    rows[cut] *= inside
    return rows, first, last


def _rank(rows: np.ndarray, first: np.ndarray, last: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = rows.view("<u8")
    with np.errstate(over="ignore"):
        x = _M3 + ((last - first) * 256 + places - first).astype(np.uint64)
        for j in range(words.shape[1]):
            x = _stir(x * _M1 + words[:, j])
    return x


def _samples(length: int, buckets: int):
    wide = length - GRAM + length
    if wide % 8:
        raise ValueError("2 * length - 20 must be a multiple of 8")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, STEP_BYTES):
                data, borders = utf8_bytes(part.column(1))
                ids = part.column(0).to_numpy()
                places, grams = cover_samples(data, borders, length)
                if not len(places):
                    continue
                rows, first, last = surroundings(data, borders, places, length)
                text = np.searchsorted(borders, places, "right") - 1
                x = np.empty(len(places), RECORD)
                x["gram"], x["around"], x["doc"], x["at"] = grams, _rank(rows, first, last, places), ids[text], places - borders[text]
                # of what this step holds twice, only the smallest document has to be compared
                copy = _copies(x)
                bucket = ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                bucket[copy] = x["doc"][copy] % buckets
                for told, own in ((False, ~copy), (True, copy)):
                    mine = np.flatnonzero(own)
                    mine = mine[np.argsort(bucket[mine], kind="stable")]
                    y, of = x[mine], bucket[mine]
                    cuts = np.flatnonzero(np.diff(of, prepend=-1))
                    ends = np.append(cuts[1:], len(y))
                    yield pa.RecordBatch.from_arrays([pa.array(of[cuts].astype(np.int32)), pa.array(np.full(len(cuts), told)), pa.array([_pack(y[a:b]) for a, b in zip(cuts, ends)], pa.binary())], ["bucket", "told", "records"])

    return run


def _copies(x: np.ndarray) -> np.ndarray:
    """Which samples have the gram and surroundings of one in a smaller document."""
    with np.errstate(over="ignore"):
        key = x["gram"] * _M3 + x["around"]
    order = np.argsort(key, kind="stable")
    key, doc, gram = key[order], x["doc"][order], x["gram"][order]
    # equal keys and grams have equal surroundings too, 64 bits each
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (gram[1:] != gram[:-1]))) if len(key) else np.zeros(0, np.int64)
    low = np.repeat(np.minimum.reduceat(doc, new), np.diff(np.append(new, len(key)))) if len(key) else doc
    out = np.zeros(len(x), bool)
    out[order] = doc > low
    return out


FOUND = "doc_id long, at int, gram long, whole boolean"


def _sorted_bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(copies, asked): samples whose surroundings an earlier document has; samples to compare."""
    copy = _copies(x)
    copies, x = x[copy], x[~copy]
    x = x[np.argsort(x["gram"], kind="stable")]
    new = np.flatnonzero(np.append(True, x["gram"][1:] != x["gram"][:-1])) if len(x) else np.zeros(0, np.int64)
    if not len(new):
        return copies, x
    size = np.diff(np.append(new, len(x)))
    several = np.minimum.reduceat(x["doc"], new) < np.maximum.reduceat(x["doc"], new)
    return copies, x[np.repeat(several, size)]


def _sort_buckets(batches):
    """Rows of a bucket come together; one bucket is held at a time."""

    def out(x, whole):
        for a in range(0, len(x), 200_000):
            y = x[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(y["doc"]), pa.array(y["at"]), pa.array(np.ascontiguousarray(y["gram"]).view(np.int64)), pa.array(np.full(len(y), whole))], ["doc_id", "at", "gram", "whole"])

    def compared(held):
        copies, asked = _sorted_bucket(_unpack(held))
        yield from out(copies, True)
        yield from out(asked, False)

    held, bucket = [], None
    for batch in batches:
        for b, told, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != bucket and held:
                yield from compared(held)
                held = []
                give_back()
            bucket = b
            if told:
                yield from out(_unpack([records.as_py()]), True)
            else:
                held.append(records.as_py())
    if held:
        yield from compared(held)
    held.clear()
    give_back()


def _fetch(length: int):
    """The surroundings of the asked samples, from their texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, STEP_BYTES):
                data, borders = utf8_bytes(part.column(1))
                asked = part.column(2)
                n = np.diff(asked.offsets.to_numpy())
                flat = asked.flatten()
                text = np.repeat(np.arange(part.num_rows), n)
                inside = np.flatnonzero(flat.field(0).to_numpy() + GRAM <= np.diff(borders)[text])
                flat, text = flat.take(pa.array(inside)), text[inside]
                at, grams = flat.field(0).to_numpy().astype(np.int64), flat.field(1)
                rows, first, last = surroundings(data, borders, borders[text] + at, length)
                wide = rows.shape[1]
                blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
                start = borders[text]
                yield pa.RecordBatch.from_arrays([grams, part.column(0).take(pa.array(text)), flat.field(0), pa.array((first - start).astype(np.int32)), pa.array((last - start).astype(np.int32)), blob], ["gram", "doc_id", "at", "first", "last", "bytes"])

    return run


def _runs(rows, at, first, last, gram, length: int):
    """For each place of the gram in a run: (which samples have the run, its two hashes, its start)."""
    before = length - GRAM
    for shift in range(before + 1):  # the run starts ``before - shift`` bytes before the gram
        start = at - before + shift
        ok = np.flatnonzero((start >= first) & (start + length <= last))
        if not len(ok):
            continue
        whole = np.zeros((len(ok), -(-length // 8) * 8), np.uint8)
        whole[:, :length] = rows[ok, shift : shift + length]
        words = whole.view("<u8")
        with np.errstate(over="ignore"):
            a, b = gram[ok].view(np.uint64) + np.uint64(shift), np.full(len(ok), _M2)
            for j in range(words.shape[1]):
                a, b = _stir(a * _M1 + words[:, j]), _stir((b ^ words[:, j]) * _M3)
        yield ok, a, b, start[ok]


def _columns(table: pa.Table):
    doc, at, first, last, gram = (table.column(c).to_numpy() for c in ("doc_id", "at", "first", "last", "gram"))
    rows = np.frombuffer(b"".join(x.as_py() for x in table.column("bytes")), np.uint8).reshape(len(doc), -1)
    return doc, at.astype(np.int64), first, last, gram, rows


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows sorted by their bytes, and how many first bytes each sorted row
    shares with the one before it."""
    n, wide = rows.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = rows
    order = np.lexsort(padded.view(">u8").T[::-1])
    differ = padded[order[1:], :wide] != padded[order[:-1], :wide]
    common = np.where(differ.any(1), differ.argmax(1), wide)
    return order, np.append(0, common)


def _stretch(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each row, the number of its stretch of sorted rows that share ``least`` first bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least) if least else 0
    return out


def _compare(length: int):
    before = length - GRAM

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The runs of some grams that are in an earlier document too."""
        doc, at, first, last, _, rows = _columns(pa.Table.from_batches(held))
        ahead, back = _ranked(rows[:, before:]), _ranked(rows[:, before - 1 :: -1])
        found = [np.zeros((3, 0), np.int64)]
        for lead in range(before + 1):  # the run starts ``lead`` bytes before its sample
            start = at - lead
            ok = np.flatnonzero((start >= first) & (start + length <= last))
            if not len(ok):
                continue
            key = (_stretch(*ahead, length - lead) * (len(doc) + 1) + _stretch(*back, lead))[ok]
            order = np.argsort(key, kind="stable")
            key, own, start = key[order], doc[ok][order], start[ok][order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            low = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
            later = own > low
            found.append(np.stack([own[later], start[later], start[later] + length]))
        d, lo, hi = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(lo), pa.array(hi)], ["doc_id", "lo", "hi"])

    def run(batches):
        """Rows of a gram come together; full groups of grams are compared at once."""
        held, rows, last = [], 0, None
        for batch in batches:
            grams = batch.column(0).to_numpy()
            cuts = np.flatnonzero(grams[1:] != grams[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grams)]):
                if rows >= HOT and grams[a] != last:
                    yield compared(held)
                    held, rows = [], 0
                held.append(batch.slice(a, b - a))
                rows, last = rows + b - a, grams[b - 1]
        if held:
            yield compared(held)
        held.clear()
        give_back()

    return run


def _spread(length: int):
    """Each run of hot grams as a row."""

    def run(batches):
        for batch in batches:
            doc, at, first, last, gram, rows = _columns(pa.Table.from_batches([batch]))
            for ok, a, b, start in _runs(rows, at, first, last, gram, length):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc[ok]), pa.array(start)], ["a", "b", "doc_id", "lo"])

    return run


def _kept(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, int]:
    """(which bytes stay, maximal removed runs)."""
    n = len(text)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.clip(lo, 0, n), 1)
    np.add.at(marks, np.clip(hi, 0, n), -1)
    gone = np.cumsum(marks[:-1]) > 0
    return ~gone, int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def _each_text(batches, each):
    """``each(text bytes, lo, hi)`` of all rows (doc_id, text, spans, ...), by steps of bounded size."""
    for batch in batches:
        for part in slices(batch, 1, STEP_BYTES):
            data, borders = utf8_bytes(part.column(1))
            spans = part.column(2)
            offsets, flat = spans.offsets.to_numpy(), spans.values
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            yield part, [each(data[borders[i] : borders[i + 1]], lo[offsets[i] : offsets[i + 1]], hi[offsets[i] : offsets[i + 1]]) for i in range(part.num_rows)]


def _digest(batches):
    def each(text, lo, hi):
        if not len(lo):
            return len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()
        stay, runs = _kept(text, lo, hi)
        return len(text), len(text) - int(stay.sum()), runs, hashlib.sha256(text[stay].tobytes()).hexdigest()

    for part, out in _each_text(batches, each):
        n, removed, runs, sha = zip(*out)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _text_left(batches):
    def each(text, lo, hi):
        if not len(lo):
            return text.tobytes().decode("utf-8", "replace")
        return text[_kept(text, lo, hi)[0]].tobytes().decode("utf-8", "ignore")  # a cut character goes as a whole

    for part, out in _each_text(batches, each):
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), part.column(3)], ["text", "rest"])


def _repeats(docs: DataFrame, length: int, bucket_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """What ``repeated_spans`` returns, and the written tables that it still reads."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    dealt = rows.mapInArrow(_samples(length, buckets), "bucket int, told boolean, records binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(_sort_buckets, FOUND), "found")
    del dealt
    release(spark)
    before = length - GRAM
    whole = found.where("whole").select("doc_id", (F.col("at") - before).cast("long").alias("lo"), (F.col("at") + length).cast("long").alias("hi"))
    asked = found.where("not whole").select("doc_id", "at", "gram")
    hot = written(asked.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram"), "hot")
    used = [found, hot]
    schema = "gram long, doc_id long, at int, first int, last int, bytes binary"
    some_hot = not hot.isEmpty()

    def near(which: DataFrame) -> DataFrame:
        own = which.groupBy("doc_id").agg(F.collect_list(F.struct("at", "gram")).alias("asked"))
        return rows.join(own.hint("merge"), "doc_id").mapInArrow(_fetch(length), schema)

    calm = asked.join(hot.hint("merge"), "gram", "left_anti") if some_hot else asked
    out = whole.unionByName(near(calm).repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(length), "doc_id long, lo long, hi long"))
    if some_hot:
        runs = written(near(asked.join(hot.hint("merge"), "gram", "left_semi")).mapInArrow(_spread(length), "a long, b long, doc_id long, lo long"), "runs")
        # written, so that the rows of a frequent run come straight from a shuffle and can be split over tasks
        low = written(runs.groupBy("a", "b").agg(F.min("doc_id").alias("low")), "low")
        used += [runs, low]
        later = runs.join(low.hint("merge"), ["a", "b"]).where("doc_id > low")
        out = out.unionByName(later.select("doc_id", "lo", (F.col("lo") + length).alias("hi")))
    return out, used


def repeated_spans(docs: DataFrame, *, length: int = 50, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, lo, hi): byte spans of ``docs`` (doc_id, text) covered by runs of ``length`` bytes
    that also start in a document with a smaller id.

    Null ids and texts shorter than ``length`` take part in nothing; no rows give none."""
    return _repeats(docs, length, bucket_bytes)[0]


def _marked(docs: DataFrame, length: int, *more: Column) -> DataFrame:
    spans, used = _repeats(docs, length, BUCKET_BYTES)
    own = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    del spans
    delete_written(*used)
    release(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return rows.join(own.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("spans", empty).alias("spans"), *["rest"] * len(more))


def remove_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """Describe each text of ``docs`` (doc_id, text) without the bytes that repeat an earlier document.

    Texts are UTF-8 bytes. A byte goes if a run of ``length`` bytes over it also starts in a
    document with a smaller doc_id, as the input stands. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256 of what is left.

    A null text is an empty one. A null id has no order: such a row keeps all and takes part in
    nothing. Repeated rows don't repeat each other (they are one document) and get one result
    each; rows that share an id must share the text. Whole texts count, however long. Other
    columns are left out; no rows give none."""
    return _marked(docs, length).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """``docs`` with all its columns, whatever their names, and the texts left by ``remove_repeats``.

    Where a cut parts a character, all of it goes, so that texts stay valid."""
    marked = _marked(docs, length, F.struct(*quoted(docs.drop("text"))).alias("rest"))
    out = marked.mapInArrow(_text_left, T.StructType([T.StructField("text", T.StringType()), marked.schema["rest"]]))
    return out.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
