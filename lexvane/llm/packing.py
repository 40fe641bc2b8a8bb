"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only lengths matter to a packing, and there are at most as many lengths as a sequence has tokens. So the driver fills
sequences from the histogram of lengths (a bounded table), whole runs of equal sequences at a time, and Spark gives each
piece the place that belongs to its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.llm.bpe import groups
from lexvane.llm.common import broadcast_if_small, claim, materialise, table

SEQUENCE = 2048
#: Chunks of text that a Python worker remembers, and as many that it used before.
MEMORY = 300_000
#: Pieces of one length are ranked in parts of about so many.
PART = 50_000


class ChunkIds:
    """ids of texts by the tokenizers library, which sees each distinct chunk (run without ASCII white space) once.

    For tokenizers whose words never hold white space and whose normaliser works within a chunk.
    """

    _loaded: dict[str, ChunkIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lowers = "Lowercase(" in repr(self.tokenizer.normalizer)  # to_str() would take the whole vocabulary's memory again
        special = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.stop_id, self.stop = (special[-1][0], special[-1][1].content) if special else (None, None)
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> ChunkIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.ids) > MEMORY:
            self.old, self.ids = self.ids, {}
        ids, plain = self.ids, []
        for c in chunks:
            if c not in ids:
                if (before := self.old.get(c)) is not None:
                    ids[c] = before
                elif self.stop is None or b"<" in c:
                    ids[c] = array("I", self.tokenizer.encode(c.decode(), add_special_tokens=False).ids).tobytes()
                else:
                    plain.append(c)
        for k in range(0, len(plain), 2000):  # one call for many chunks, with a special token after each
            some = plain[k : k + 2000]
            row = array("I", self.tokenizer.encode_batch_fast([self.stop.join(c.decode() for c in some) + self.stop], add_special_tokens=False)[0].ids)
            body, start, at = row.tobytes(), 0, -1
            for c in some:
                at = row.index(self.stop_id, at + 1)
                ids[c] = body[4 * start : 4 * at]
                start = at + 1

    def _plain(self, text: bytes) -> bytes:
        """Lower case at once, where the normaliser does nothing else then and no special token can be meant: fewer distinct chunks."""
        if not self.lowers or b"<" in text:
            return text
        if text.isascii():
            return text.lower()
        low = text.decode()
        if "\u03a3" in low or not unicodedata.is_normalized("NFC", low):  # str.lower() gives a sigma its final form
            return text
        low = low.lower()
        return low.encode() if unicodedata.is_normalized("NFC", low) else text

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        rows = [self._plain(t or b"").split() for t in texts]
        self.learn(set().union(*rows))
        ids = self.ids
        for row in rows:
            yield b"".join(map(ids.__getitem__, row))


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and end_id; only longer ones than length are cut, into pieces of that length and a rest. A null
    text counts as empty, so each row gives one piece at least. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = array("I", [end_id]).tobytes()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        claim("packing", ChunkIds._loaded.clear)
        coder = ChunkIds.load(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, stop in groups(texts):
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for i, body in enumerate(coder.encode_all(texts[first:stop]), first):
                    body += end
                    for p, at in enumerate(range(0, len(body), 4 * length)):
                        part = body[at : at + 4 * length]
                        rows.append(i)
                        pieces.append(p)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(memoryview(part).cast("I").tolist())
                columns = [keys.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key, F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def fill(counts: dict[int, int], length: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences), by best-two-fit on a histogram of lengths.

    A sequence takes the longest piece, then again and again the longest that fits. Then its smallest piece gives way to two
    pieces that together fill the gap and its place more tightly, if there are any. Equal sequences come in runs, as long as
    the histogram lasts, so the work depends on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    runs = []
    while sizes:
        take: dict[int, int] = {}
        row, gap = [], length
        while True:
            at = bisect_right(sizes, gap) - 1
            while at >= 0 and left[sizes[at]] <= take.get(sizes[at], 0):
                at -= 1
            if at < 0:
                break
            n = sizes[at]
            row.append(n)
            take[n] = take.get(n, 0) + 1
            gap -= n
        if gap and len(row) > 1 and (pair := _two(sizes, left, take, row[-1] + gap, row[-1])):
            take[row[-1]] -= 1
            row[-1:] = pair
            for n in pair:
                take[n] = take.get(n, 0) + 1
        take = {n: k for n, k in take.items() if k}
        times = min(left[n] // k for n, k in take.items())
        runs.append((row, times))
        for n, k in take.items():
            left[n] -= k * times
        sizes = [n for n in sizes if left[n]]
    return runs


def _two(sizes: list[int], left: dict[int, int], take: dict[int, int], room: int, least: int) -> list[int] | None:
    """The two free lengths of greatest sum that is over least and at most room; the more even pair of equal sums."""
    free = [n for n in sizes if n < room and left[n] > take.get(n, 0)]
    best, found, low, high = least, None, 0, len(free) - 1
    while low <= high:
        total = free[low] + free[high]
        if total > room or low == high and left[free[low]] - take.get(free[low], 0) < 2:
            high -= 1
            continue
        if total >= best and total > least:
            best, found = total, [free[high], free[low]]
        low += 1
    return found


def pack(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """pieces (with a column length of 1 to `length`) with sequence_id and offset; columns of these names are replaced.

    Each sequence is filled from 0 without gaps. Equal lengths are ranked by all other columns that can be ordered, so the
    result does not depend on partitions, but for rows that are equal in all of them. Pieces that fill a sequence alone need no
    rank: theirs have negative ids, by their place in the files. pieces is read several times: write it first.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `length` rows at most
    if counts and not (None not in counts and 1 <= min(counts) <= max(counts) <= length):
        raise ValueError(f"lengths have to be from 1 to {length}")
    alone = pieces.filter(F.col("length") == length).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts.pop(length, None)
    if not counts:
        return alone
    places, sequence, given = [], 0, {}
    for row, times in fill(counts, length):
        at = 0
        for n in sorted(set(row), reverse=True):
            k = row.count(n)
            first = given.get(n, 0)
            places.append((n, first, first + k * times, k, sequence, at))
            given[n] = first + k * times
            at += k * n
        sequence += times
    spark = pieces.sparkSession
    # a run ends a length or takes it below its share, so there are a few thousand runs at most
    layout = spark.createDataFrame(places, "length long, from_rank long, to_rank long, share long, first_sequence long, base long")
    parts = spark.createDataFrame([(n, -(-c // PART)) for n, c in counts.items()], "length long, n_parts long")
    short = pieces.filter(F.col("length") < length).select(*columns, F.xxhash64(*columns).alias("pack_hash"))
    dealt = short.join(F.broadcast(parts), "length").withColumn("pack_part", F.pmod("pack_hash", "n_parts"))
    if max(counts.values()) > PART:
        before = Window.partitionBy("length").orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy("length", "pack_part").agg(F.count("*").alias("n"))
        starts = materialise(sizes.select("length", "pack_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_start")), "starts")
        dealt = dealt.join(broadcast_if_small(starts, 1_000_000), ["length", "pack_part"])  # a row for each length and each PART pieces
    else:
        dealt = dealt.withColumn("pack_start", F.lit(0))
    within = Window.partitionBy("length", "pack_part").orderBy(*[c for c in columns if c != "length" and pieces.schema[c].dataType.typeName() != "map"])
    ranked = dealt.withColumn("pack_rank", F.col("pack_start") + F.row_number().over(within) - 1)
    inside = (ranked["length"] == layout["length"]) & (F.col("pack_rank") >= F.col("from_rank")) & (F.col("pack_rank") < F.col("to_rank"))
    step = F.col("pack_rank") - F.col("from_rank")
    share = F.col("share")
    sequence_id = (F.col("first_sequence") + F.floor(step / share)).cast("long").alias("sequence_id")
    offset = (F.col("base") + (step % share) * ranked["length"]).cast("long").alias("offset")
    packed = ranked.join(F.broadcast(layout), inside).select(*[ranked[c] for c in columns], sequence_id, offset)
    return packed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; a group holds no more tokens than a sequence."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all rows' texts with their sequence and offset.

    A null or empty text is the end token alone. Repeated rows are packed each; texts longer than a sequence are cut into pieces,
    none is left out; an empty table gives an empty one; other columns are not read.
    """
    return pack(materialise(token_pieces(docs, path, key, text), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; repeated rows are packed each, and an empty table gives an empty one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
