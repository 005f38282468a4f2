"""Content-defined line chunks: repeated multi-line chunks are removed.

A text is cut at "\\n" into lines.  A rolling hash over the hashes of the last
ROLL lines sets chunk ends where it falls in one of MODULUS classes, so ends
depend on nearby lines only and survive insertions before them.  Chunks have
MIN_LINES to MAX_LINES lines; the last chunk of a text may be shorter.
A chunk of at least two lines whose bytes occur in several places of the
corpus stays at its first place (lowest doc_id, then lowest chunk number) and
is removed everywhere else.

Places are found by 64-bit chunk hash.  The texts of the chunks with a
repeated hash are then compared: grouping is by the chunk's bytes, so a hash
collision never removes anything.  Only such chunks travel: a bitmap of
repeated hashes, of fixed size, tells the tasks which (a false positive costs
traffic only).

Null texts stay null and empty texts empty; a text of which every chunk is
removed becomes empty, its row stays.  Rows that repeat a doc_id count as one
document if they have the same text: the same chunk at the same place of both
is one place and stays in both.  With different texts they are documents of
their own, the one of lower text hash first.  A null doc_id comes before all
others.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bitmap, marked
from .spark import fresh, map_batches, parts, release, stored
from .text import prefix_hashes, slices, span_hashes, utf8, windows

ROLL, MODULUS, MIN_LINES, MAX_LINES = 2, 3, 2, 64


def chunk_ends(hashes: np.ndarray, roll: int = ROLL, modulus: int = MODULUS, least: int = MIN_LINES, most: int = MAX_LINES) -> list[int]:
    """Chunk ends (exclusive line numbers) of a text's line hashes."""
    n = len(hashes)
    cuts = (np.flatnonzero(windows(hashes, roll) % np.uint64(modulus) == 0) + roll).tolist()
    out, begin = [], 0
    for cut in [*cuts, n]:
        while cut - begin > most:
            begin += most
            out.append(begin)
        if cut - begin >= least or cut == n and cut > begin:
            out.append(cut)
            begin = cut
    return out


def chunks(column):
    """Per document: [(number, byte start, byte end, lines, hash)] of its chunks, and its bytes.

    A chunk's bytes leave out the newline after its last line.
    """
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = data[offsets[first]: offsets[last]]
        local = offsets[first: last + 1] - offsets[first]
        breaks = np.flatnonzero(part == 10)
        where = np.searchsorted(breaks, local)
        prefix = prefix_hashes(part) if len(breaks) else None
        for d in range(last - first):
            a, b = int(local[d]), int(local[d + 1])
            inner = breaks[where[d]: where[d + 1]]
            if not len(inner):
                yield [], part[a:b]
                continue
            starts = np.concatenate(([a], inner + 1))
            ends = np.concatenate((inner, [b]))
            stops = chunk_ends(span_hashes(prefix, starts, ends))
            heads = [0, *stops[:-1]]
            low, high = starts[heads], ends[np.array(stops) - 1]
            hashes = span_hashes(prefix, low, high).view(np.int64)
            yield [(k, int(low[k]) - a, int(high[k]) - a, stops[k] - heads[k], int(hashes[k])) for k in range(len(stops))], part[a:b]


def _places(docs: DataFrame, keep=None) -> DataFrame:
    """(h, doc_id, version, number[, chunk]) of the multi-line chunks; with the bitmap ``keep``, those it marks, with their text."""
    ddl = "h long, doc_id long, version long, number int" + (", chunk binary" if keep is not None else "")

    def run(batch):
        for part in parts(batch):
            yield of_part(part)

    def of_part(batch):
        out = {"h": [], "doc_id": [], "version": [], "number": [], "chunk": []}
        for doc, version, (found, raw) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), chunks(batch.column(1)), strict=True):
            for number, a, b, lines, h in found:
                if lines < 2 or keep is not None and not marked(keep.value, h):
                    continue
                out["h"].append(h), out["doc_id"].append(doc), out["version"].append(version), out["number"].append(number)
                if keep is not None:
                    out["chunk"].append(raw[a:b].tobytes())
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _version().alias("version")), run, ddl)


def _version():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, version, numbers): the chunks to remove from each document that loses any."""
    repeated = _places(docs).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(repeated))
    places = stored(_places(docs, sent))
    # equal bytes are one group; the first place of each stays
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "version", "number")
    groups = stored(places.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    clash = groups.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    plain = groups.where("n > 1").join(clash, "h", "left_anti").select("h", "first")
    gone = places.select("h", "doc_id", "version", "number").join(plain, "h")
    mixed = places.join(clash, "h", "left_semi").join(groups.where("n > 1").select("h", "chunk", "first"), ["h", "chunk"])
    columns = ("doc_id", "version", "number", "first")
    gone = gone.select(*columns).union(mixed.select(*columns))
    stays = [F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.col("version") == F.col("first.version"), F.col("number") == F.col("first.number")]
    gone = gone.where(~(stays[0] & stays[1] & stays[2]))
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def cleaned(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with repeated chunks removed from text, and columns for the lines before and the lines removed."""
    lost, lines, removed = fresh(docs, "lost_chunks"), fresh(docs, "n_lines"), fresh(docs, "n_removed_lines")
    key, version, named = fresh(docs, "lost_key"), fresh(docs, "lost_version"), fresh(docs, "lost_name")
    gone = stored(removals(docs))
    name_of = F.xxhash64(F.col("doc_id").cast("long"), _version())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("doc_id", "version").alias("h"))))
    rows = docs.withColumn(named, name_of)

    def parted(wanted):
        """The rows that the bitmap marks, or all others: only marked texts travel to the join."""
        def run(batches):
            release()
            for batch in (part for whole in batches for part in parts(whole)):
                names = batch.column(batch.schema.get_field_index(named)).to_pylist()
                mask = pa.array([marked(sent.value, h) == wanted for h in names], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], schema=batch.schema)
        return run

    gone = gone.select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("numbers").alias(lost))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (_version() == F.col(version))
    losing = rows.mapInArrow(parted(True), rows.schema).join(gone, mine, "left").drop(key, version, named)
    schema = pa.schema([(lines, pa.int64()), (removed, pa.int64())])

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            name = batch.schema.get_field_index
            old, drop = batch.column(name("text")), batch.column(name(lost)).to_pylist()
            texts, n, m = [], [], []
            missing = old.is_null().to_pylist()
            for at, (found, raw) in enumerate(chunks(old)):
                out = drop[at] and set(drop[at])
                n.append(sum(c[3] for c in found) or int(len(raw) > 0))
                m.append(sum(c[3] for c in found if c[0] in out) if out else 0)
                if missing[at]:
                    texts.append(None)
                elif out:
                    texts.append(b"\n".join(raw[a:b].tobytes() for k, a, b, _, _ in found if k not in out).decode())
                else:
                    texts.append(raw.tobytes().decode())
            columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names) if f != lost}
            columns["text"] = pa.array(texts, old.type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                                             names=[*columns, *schema.names])

    def run_losing(batches):
        release()
        yield from run(batches)

    def run_others(batches):  # in one worker: told apart and passed on
        for batch in parted(False)(batches):
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != named]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield from run([pa.RecordBatch.from_arrays([*(c for _, c in kept), none], names=[*(n for n, _ in kept), lost])])

    from pyspark.sql.types import LongType, StructField, StructType
    schema_out = StructType([*docs.schema.fields, StructField(lines, LongType()), StructField(removed, LongType())])
    out = rows.mapInArrow(run_others, schema_out).unionByName(losing.select(*(f"`{c}`" for c in docs.columns), f"`{lost}`").mapInArrow(run_losing, schema_out))
    return out, lines, removed
