"""Exact de-duplication over an extendible-hash index on shared files, in DataFrame functions.

Every row's normalised text is hashed to 64 bits; the first bits of the hash are its directory slot.
The directory starts with a single bucket; a bucket of more than ``capacity`` distinct hashes is
split, which doubles the directory where needed. It may double until it has eight times as many
slots as the measured number of hashes needs buckets, so it grows with the input. Rows are dealt by
slot and hash; inside, texts are compared by their bytes, and different texts of one hash become a
chain. The index lies in the shared checkpoint folder, sorted by bucket, hash and chain, with tasks
owning ranges of keys; an entry is a distinct text, not a row, so a text that a third of all rows have is
one entry of every task that has seen it. Rows come back to their entry by bucket, hash and chain. A hash
without a chain has one text, as every row took part in the comparison; rows of a chained hash are
compared with the texts of its chain, which the index keeps.

Defined cases: a null text is empty; of equal texts the one with the most code points, then the
smallest key, stays, and a null key comes after every other. Rows that repeat the kept row's key
and length are all flagged as kept; ``survivors`` returns one of them, the least by its other
columns. Extra columns are carried by ``survivors`` under any name. An empty table gives an
empty result. Texts that share a hash are told apart whatever the hash; hashes that agree in all bits
of the directory share a bucket, which may then hold more than ``capacity``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from towerlens.llm.memory import checked
from towerlens.session import materialise, work_folder

CAPACITY = 4096
# Doublings beyond the depth that evenly spread hashes need, and the most that an int slot allows.
SPARE_DEPTH = 3
MOST_DEPTH = 30
_NULL_KEY = 2**63
_SCALE = 10**20


def normalised(text):
    """The text without the characters space, tab, line feed, vertical tab, form feed, return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _number(value, digits):
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def _order(points, key):
    """One number that is larger for the row that should stay: more points, then smaller key."""
    key = F.coalesce(key.cast("decimal(20,0)"), _number(_NULL_KEY, 20))
    high = points.cast("decimal(11,0)") * _number(_SCALE, 21)
    return (high + (_number(_NULL_KEY, 20) - key)).cast("decimal(38,0)")


def _key_of(order):
    low = (order % _number(_SCALE, 21)).cast("decimal(21,0)")
    return F.when(low != 0, (_number(_NULL_KEY, 20) - low).cast("long"))


def _hashed(docs, key, text, hash_of):
    norm = normalised(F.col(text))
    points = F.char_length(F.coalesce(F.col(text), F.lit("")))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        _order(points, F.col(key)).alias("rank"),
        norm.alias("norm"),
    ).withColumn("hash", hash_of(F.col("norm")))


def _slot(depth):
    """The first ``depth`` bits of the hash; shifted twice, as a shift by 64 would be one by 0."""
    return F.shiftrightunsigned(F.shiftrightunsigned("hash", 1), 63 - depth).cast("int")


def depth_for(n_hashes, capacity=CAPACITY):
    """Bits of a directory for so many hashes."""
    buckets = -(-n_hashes // capacity)
    return 0 if buckets <= 1 else min(MOST_DEPTH, (buckets - 1).bit_length() + SPARE_DEPTH)


def directory(hashes, depth, capacity=CAPACITY):
    """Bucket of each used slot, from distinct hashes: slot, depth, bucket.

    A slot belongs to the shallowest prefix that holds no more than ``capacity`` hashes, which
    is where splitting one bucket after another ends; ``bucket`` is the prefix's first slot.
    """
    slots = hashes.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    totals = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("total"))
    fits = totals.filter((F.col("total") <= capacity) | (F.col("depth") == depth))
    found = levels.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    free = F.expr(f"shiftleft(1, {depth} - depth)")
    return found.withColumn("bucket", F.col("slot") - F.col("slot") % free)


class Index:
    """A built index, to find the entries of its rows.

    ``entries`` has bucket, hash, chain, n_chain, text_sha256, group_size and rank; ``chained`` has the
    same for the texts of chains, with the text (``norm``), or is None where no hash has two texts.
    """

    def __init__(self, depth, slots, entries, chained):
        self.depth, self.slots, self.entries, self.chained = depth, slots, entries, chained

    def located(self, rows, texts):
        """``rows`` (with their hash) beside the columns of their entry.

        ``texts`` are the same rows with their normalised text, read only where there are chains: the
        bytes of the text say which link of its chain a row belongs to.
        """
        found = self._dealt(rows).join(self.entries.filter("n_chain = 1"), ["bucket", "hash"])
        if self.chained is None:
            return found
        linked = self._dealt(texts).join(self.chained, ["bucket", "hash", "norm"])
        return found.unionByName(linked.select(*found.columns))

    def _dealt(self, rows):
        return rows.withColumn("slot", _slot(self.depth)).join(self.slots, "slot").drop("slot")


def build_index(docs, path, key="doc_id", text="text", capacity=CAPACITY, hash_of=F.xxhash64, hashes=None):
    """Write the index of ``docs`` to the shared folder ``path`` and return it.

    ``hash_of`` makes a long of a column of text. ``hashes`` are the hashes of all rows where the
    caller has them already, in ``hash``. Copies are combined by each task before they are shuffled.
    """
    spark = docs.sparkSession
    rows = _hashed(docs, key, text, hash_of)
    hashes = materialise((rows if hashes is None else hashes).select("hash").distinct())
    depth = depth_for(hashes.count(), capacity)
    directory(hashes, depth, capacity).write.mode("overwrite").parquet(f"{path}/directory")
    slots = spark.read.parquet(f"{path}/directory").select("slot", "bucket")
    slots = checked(slots, slots.count())

    numbers = [F.count("*").alias("group_size"), F.max("rank").alias("rank")]
    dealt = rows.withColumn("slot", _slot(depth))
    same = dealt.groupBy("slot", "hash", "norm").agg(*numbers)
    found = materialise(
        same.select("slot", "hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", "rank").withColumn(
            "n_chain", F.count("*").over(Window.partitionBy("slot", "hash"))
        )
    )
    entries = _placed(found.filter("n_chain = 1").withColumn("chain", F.lit(0)), slots)
    chained = None
    collided = found.filter("n_chain > 1")
    if not collided.isEmpty():
        # Only the texts of hashes that have several are read again, to be kept with their chain.
        again = dealt.join(collided.select("hash").distinct(), "hash", "left_semi")
        links = again.groupBy("slot", "hash", "norm").agg(*numbers)
        at = Window.partitionBy("slot", "hash")
        links = links.withColumns(
            {
                "chain": F.row_number().over(at.orderBy("norm")) - 1,
                "n_chain": F.count("*").over(at),
                "text_sha256": F.sha2("norm", 256),
            }
        )
        _store(_placed(links, slots, "norm"), f"{path}/chained")
        chained = spark.read.parquet(f"{path}/chained")
        entries = entries.unionByName(chained.drop("norm"))
    _store(entries, f"{path}/entries")
    return Index(depth, slots, spark.read.parquet(f"{path}/entries"), chained)


def _placed(entries, slots, *more):
    columns = ["bucket", "hash", "chain", "n_chain", "text_sha256", "group_size", "rank", *more]
    return entries.join(slots, "slot").select(*columns)


def _store(entries, path):
    """Entries in order of bucket, hash and chain; each task writes one range of keys."""
    order = ["bucket", "hash", "chain"]
    entries.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def groups(docs, key="doc_id", text="text", path=None, capacity=CAPACITY, hash_of=F.xxhash64):
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    The index is written to ``path``, by default to a new folder in the checkpoint folder.
    """
    path = path or f"{work_folder(docs.sparkSession)}/index"
    texts = _hashed(docs, key, text, hash_of).withColumnRenamed("rank", "own")
    rows = materialise(texts.drop("norm"))
    index = build_index(docs, path, key, text, capacity, hash_of, rows)
    return index.located(rows, texts).select(
        "doc_id",
        _key_of(F.col("rank")).alias("keep_id"),
        "group_size",
        (F.col("own") == F.col("rank")).alias("kept"),
        "text_sha256",
        "bucket",
    )


def survivors(docs, key="doc_id", text="text", capacity=CAPACITY, hash_of=F.xxhash64):
    """The rows of ``docs`` that stay, with all their columns.

    Rows that share key and length with the kept row are repeats of it; of these, the least by
    all columns stays.
    """
    path = f"{work_folder(docs.sparkSession)}/index"
    index = build_index(docs, path, key, text, capacity, hash_of)
    names = docs.columns
    flat = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at, body = f"c{names.index(key)}", f"c{names.index(text)}"
    rank = _order(F.char_length(F.coalesce(F.col(body), F.lit(""))), F.col(at))
    texts = flat.withColumns({"norm": normalised(F.col(body)), "own": rank}).withColumn("hash", hash_of(F.col("norm")))
    kept = index.located(texts.drop("norm"), texts).filter("own = rank")
    columns = flat.columns
    alone = kept.filter("group_size = 1").select(*columns)
    shared = (
        kept.filter("group_size > 1")
        .groupBy("bucket", "hash", "chain")
        .agg(F.min(F.struct(*columns)).alias("row"))
        .select(*[F.col(f"row.{c}").alias(c) for c in columns])
    )
    return alone.unionAll(shared).toDF(*names)
