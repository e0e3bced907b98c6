"""Language-model scores of whole documents by a gated recurrent network.

All training texts are counted word by word.  The network's vocabulary is the
``HEAD`` most frequent words, in ``HEAD_CLASSES`` classes by frequency; every other
word belongs to one of ``TAIL_CLASSES`` tail classes by its last two bytes, inside
which its probability is (c + 0.1) / (n + 0.1 * (v + 1)) over the class's training
words, one share standing for all words never seen.  So

    log P(text) = sum over words and the end of log P(class | words before) + log P(word | class, words before)

with the state carried through the whole text.  The network is trained by truncated
backpropagation on all training documents once.  They are dealt by a hash of their id
(of the row number where that is null) over rounds and replicas, about ``SLOT_WORDS``
words to each replica of each round; each round, the replicas learn from their slots and
their weights and squared gradients are averaged by their tokens.  Rounds grow with the
root of the corpus, so updates follow the corpus and not the layout of its files.

Words are compared by 64-bit hashes of their A-Z lower-cased bytes.  Counts of the
most frequent words (at most ``BROADCAST_WORDS``) go to all tasks; rarer words of
texts meet their counts in a join, in which no key is frequent.

Null and empty texts hold just their end.  Without training text all words are
unknown and the model is that of equal classes.  Repeated rows count and score each;
a null id counts as an empty one, whose crc32 is 0, so such texts are held out.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import gru
from driftline.llm import textkernel as tk
from driftline.llm.shared import new_path, remainder, table, written

HEAD = 2048
HEAD_CLASSES = 24
TAIL_CLASSES = 32
#: Words that one replica learns from in one round.
SLOT_WORDS = 1_000_000
BROADCAST_WORDS = 400_000
#: Words that one task scores in step; one longer document goes alone.
POOL_WORDS = 3_000_000
#: Words counted before the counts of a task are handed on.
COUNT_WORDS = 4_000_000
#: Replicas that one task averages.
FAN_IN = 8

END = np.uint64(0x0E4D0E4D0E4D0E4D)
_NO_SUFFIX = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of each row, word hashes, suffixes), each row closed by its end."""
    starts, ends, counts = tk.words(data, offsets)
    key = tk.Spans(data, tk.LOWER).hash(starts, ends)
    low = tk.LOWER[data].astype(np.int32)
    suffix = low[ends - 1] + 256 * np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
    at = np.cumsum(counts)
    return counts + 1, np.insert(key, at, END), np.insert(suffix, at, _NO_SUFFIX)


def count_words(texts: DataFrame) -> DataFrame:
    """(key, suffix, n) of all words and ends of one text column."""

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0)):
                _, key, suffix = tokens(data, offsets)
                held.append(_sums(key, suffix, np.ones(len(key), dtype=np.int64)))
                size += len(held[-1][0])
                if size >= COUNT_WORDS:
                    held = [_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) >= COUNT_WORDS // 2:
                        yield rows(held.pop())
                    size = sum(len(x[0]) for x in held)
        if held:
            yield rows(_sums(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].astype(np.int32)), pa.array(found[2])], ["key", "suffix", "n"])

    return texts.mapInArrow(run, "key long, suffix int, n long").groupBy("key").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def _sums(key: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, suffix, n
    order = np.argsort(key)
    key, suffix, n = key[order], suffix[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], suffix[at], np.add.reduceat(n, at)


class Vocabulary:
    """What tasks know of words: counts of frequent ones, and the class of any."""

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.total, self.distinct = int(totals["n"] or 0), int(totals["v"])
        sizes = counts.groupBy("n").count().orderBy(F.col("n").desc())
        running, least = 0, 1 << 62
        for row in sizes.toLocalIterator():
            running += row["count"]
            if running > BROADCAST_WORDS:
                break
            least = row["n"]
        known = counts.where(F.col("n") >= least).select("key", "suffix", "n").toPandas()
        known = known.sort_values(["n", "key"], ascending=[False, True], ignore_index=True)
        key, n = known["key"].to_numpy(dtype=np.int64).view(np.uint64), known["n"].to_numpy(dtype=np.int64)
        head = min(HEAD, len(key))
        weight = np.cumsum(np.sqrt(n[:head]))
        self.head_class = np.minimum((weight / max(weight[-1] if head else 1, 1) * HEAD_CLASSES).astype(np.int64), HEAD_CLASSES - 1)
        self.spans = np.append(np.searchsorted(self.head_class, np.arange(HEAD_CLASSES)), head)
        self.head_n = n[:head]
        # tail classes: the suffixes with most words outside the head, and one for the rest
        outside = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(k),) for k in key[:head].view(np.int64)], "key long")), "key", "left_anti")
        tails = outside.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.col("n").desc(), "suffix").toPandas()
        self.suffixes = np.full(1 << 16, HEAD_CLASSES + TAIL_CLASSES - 1, dtype=np.int64)
        top = tails["suffix"].to_numpy(dtype=np.int64)[: TAIL_CLASSES - 1]
        self.suffixes[top] = HEAD_CLASSES + np.arange(len(top))
        place = self.suffixes[tails["suffix"].to_numpy(dtype=np.int64)] - HEAD_CLASSES
        self.tail_n = np.bincount(place, weights=tails["n"].to_numpy(dtype=float), minlength=TAIL_CLASSES)
        self.tail_v = np.bincount(place, weights=tails["v"].to_numpy(dtype=float), minlength=TAIL_CLASSES)
        # each slot of a table of places holds its most frequent word; words that lose their slot are searched
        self.keys, self.n = key, n
        self.slots = np.full(1 << max(10, (4 * len(key)).bit_length()), -1, dtype=np.int32)
        slot = (key & np.uint64(len(self.slots) - 1)).astype(np.int64)
        self.slots[slot[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.slots[slot] != np.arange(len(key)))
        self.lost = lost[np.argsort(key[lost])]
        self.inputs = head + TAIL_CLASSES
        self.start = self.inputs

    def lookup(self, key: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(count or 0 if not among the known, word or -1, class, input) of each word."""
        rank = self.slots[(key & np.uint64(len(self.slots) - 1)).astype(np.int64)].astype(np.int64)
        if len(self.keys):
            rank[self.keys[rank] != key] = -1
        if len(self.lost):
            missed = np.flatnonzero(rank < 0)
            place = self.lost[np.minimum(np.searchsorted(self.keys[self.lost], key[missed]), len(self.lost) - 1)]
            rank[missed] = np.where(self.keys[place] == key[missed], place, -1)
        count = np.where(rank >= 0, self.n[rank] if len(self.keys) else 0, 0)
        rank = np.where(rank >= 0, rank, 1 << 60)
        head = rank < len(self.head_class)
        word = np.where(head, rank, -1)
        classes = self.suffixes[suffix]
        classes[head] = self.head_class[rank[head]]
        return count, word, classes, np.where(head, rank, len(self.head_class) + classes - HEAD_CLASSES)

    def new_model(self) -> dict:
        mass = np.append(np.bincount(self.head_class, weights=self.head_n, minlength=HEAD_CLASSES), self.tail_n) + 0.5
        words = np.log(np.maximum(self.head_n, 1) / max(1.0, self.head_n.mean())) if len(self.head_n) else np.zeros(0)
        return gru.new_model(np.log(mass / mass.sum()), words, self.inputs + 1)


def _pack(model: dict) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _averaged(replicas: DataFrame) -> tuple[np.ndarray | None, int]:
    """Token-weighted mean of (replica, n, weights) rows, by a tree of small groups."""

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        total = sum(float(k) * np.frombuffer(w, dtype=np.float32) for k, w in zip(n, table.column("weights").to_pylist(), strict=True)) / n.sum()
        return pa.table({"replica": pa.array([table.column("group")[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    number = replicas.count()
    while number > FAN_IN:
        replicas = replicas.withColumn("group", F.floor(F.col("replica") / FAN_IN)).groupBy("group").applyInArrow(mean, "replica long, n long, weights binary")
        replicas = written(replicas, "replicas")
        number = replicas.count()
    rows = replicas.collect()
    total = sum(r["n"] for r in rows)
    if not total:
        return None, 0
    return sum(r["n"] * np.frombuffer(r["weights"], dtype=np.float32).astype(float) for r in rows) / total, total


def schedule(total: int, slot_words: int = SLOT_WORDS) -> tuple[int, int]:
    """(rounds, replicas) for a number of words: slots of a fixed size, twice as many replicas as rounds."""
    slots = max(1, math.ceil(total / slot_words))
    rounds = math.ceil(math.sqrt(slots / 2))
    return rounds, math.ceil(slots / rounds)


def dealt(training: DataFrame, words: Vocabulary, rounds: int, replicas: int) -> DataFrame:
    """(key, row, replica, inputs, round) of all training rows (id, row, text), written by round."""
    spark = training.sparkSession
    known = spark.sparkContext.broadcast(words)

    def run(batches):
        words = known.value
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(3)):
                counts, key, suffix = tokens(data, offsets)
                inputs = words.lookup(key, suffix)[3]
                lists = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                columns = [batch.column(k).slice(first, last - first) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(lists, pa.array(inputs.astype(np.int16)))], ["key", "row", "slot", "inputs"])

    key = F.coalesce("id", "row")
    slot = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(rounds * replicas))
    found = training.select(key.alias("key"), "row", slot.cast("int").alias("slot"), "text").mapInArrow(run, "key long, row long, slot int, inputs array<short>")
    path = new_path(spark, "train-tokens")
    found.select("key", "row", F.floor(F.col("slot") / rounds).cast("int").alias("replica"), "inputs", (F.col("slot") % rounds).alias("round")).write.partitionBy("round").parquet(path)
    return spark.read.schema("key long, row long, replica int, inputs array<short>, round int").parquet(path)


def train(training: DataFrame, words: Vocabulary, slot_words: int = SLOT_WORDS) -> dict:
    """The network's weights after all rounds over all training rows (id, row, text)."""
    spark, model = training.sparkSession, words.new_model()
    if not words.total:
        return model
    rounds, replicas = schedule(words.total, slot_words)
    slots = dealt(training, words, rounds, replicas)
    known, squares = spark.sparkContext.broadcast(words), None
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((model, squares))

        def run(batches, sent=sent):
            words, (model, squares) = known.value, sent.value
            trainer, size, replica = gru.Trainer(model, words.spans, words.start), 0, 0
            if squares is not None:
                trainer.squares = {k: v.copy() for k, v in squares.items()}
            head = len(words.head_class)
            held: list = []

            def learn():
                inputs, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
                word = np.where(inputs < head, inputs, -1)
                classes = inputs - head + HEAD_CLASSES
                classes[word >= 0] = words.head_class[word[word >= 0]]
                first = np.zeros(len(inputs), dtype=bool)
                first[np.cumsum(lengths) - lengths] = True
                trainer.train(inputs, classes, word, first)

            waiting = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                replica, lists = batch.column(0)[0].as_py(), batch.column(1)
                held.append((lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)))
                waiting, size = waiting + len(held[-1][0]), size + len(held[-1][0])
                if waiting >= POOL_WORDS // 2:
                    learn()
                    held, waiting = [], 0
            if held:
                learn()
            if size:
                weights = np.concatenate([_pack(trainer.p), _pack(trainer.squares)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([replica], pa.int64()), pa.array([size], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["replica", "n", "weights"])

        # one replica to a task; the order of rows is that of their keys, whatever the files
        part = slots.where(F.col("round") == number).repartitionById(replicas, F.col("replica")).sortWithinPartitions("key", "row").select("replica", "inputs")
        flat, _ = _averaged(written(part.mapInArrow(run, "replica long, n long, weights binary"), "replicas"))
        if flat is not None:
            half = len(flat) // 2
            model, squares = _unpack(flat[:half], model), _unpack(flat[half:], model)
    return model


_SCORES = "id long, row long, n_tokens long, n_known long, base double, score double, rare array<long>, rare_n array<int>"


def _partial_scores(rows: DataFrame, words: Vocabulary, model: dict) -> DataFrame:
    """Scores but for the counts of rare words, which are listed by key."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((words, model))

    def run(batches):
        words, model = sent.value
        divisor = np.log10(words.total + 0.1 * (words.distinct + 1))
        tail_divisor = np.log10(np.maximum(words.tail_n + 0.1 * (words.tail_v + 1), 0.1))

        def flush(held):
            ids, places = pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held])
            inputs, classes, word, sums = [], [], [], []
            rare_row, rare_key, offset = [], [], 0
            for _, _, counts, key, suffix in held:
                count, w, k, x = words.lookup(key, suffix)
                row = tk.rows_of(counts)
                part = np.log10(count + 0.1)
                rare = np.flatnonzero(count == 0)
                rare_row.append(row[rare] + offset)
                rare_key.append(key[rare])
                offset += len(counts)
                part[rare] = 0
                known = tk.per_row(row, len(counts), (count > 0).astype(float))
                tail = np.flatnonzero(k >= HEAD_CLASSES)
                inside = np.bincount(row[tail], weights=part[tail] - tail_divisor[k[tail] - HEAD_CLASSES], minlength=len(counts))
                sums.append((counts, known, tk.per_row(row, len(counts), part) - counts * divisor, inside))
                cuts = np.cumsum(counts)[:-1]
                for into, values in ((inputs, x.astype(np.int32)), (classes, k.astype(np.int32)), (word, w.astype(np.int32))):
                    into += np.split(values, cuts)
            counts, known, base, inside = (np.concatenate(x) for x in zip(*sums, strict=True))
            score = gru.document_scores(model, words.spans, words.start, inputs, classes, word) / np.log(10) + inside
            row, key, n = tk.distinct(np.concatenate(rare_row), np.concatenate(rare_key))
            lists = pa.array(np.append(0, np.cumsum(tk.per_row(row, len(counts)))).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [ids, places, pa.array(counts.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(lists, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(n.astype(np.int32)))],
                [x.split()[0] for x in _SCORES.split(", ")],
            )

        held, size = [], 0
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(2)):
                found = tokens(data, offsets)
                held.append((batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *found))
                size += len(found[1])
                if size >= POOL_WORDS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.select("id", "row", "text").mapInArrow(run, _SCORES)


def language_scores(docs: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row, learned from rows that fit ``usable``; scores are log10."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    training = docs.where(F.lit(True) if usable is None else usable).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text)
    counts = written(count_words(training.select("text")), "word-counts")
    words = Vocabulary(counts)
    model = train(training, words)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text)
    partial = written(_partial_scores(rows, words, model), "partial-scores")
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("times"))
    met = rare.join(counts.select("key", "n"), "key", "left")
    c = F.coalesce("n", F.lit(0))
    added = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("added"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"))
    joined = partial.drop("rare", "rare_n").join(added, "row", "left")
    extra = F.coalesce("added", F.lit(0.0))
    return joined.select("id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))


def query(spark, sf_dir):
    """op4: every document scored, learning from rows whose crc32 modulo 10 is not 0."""
    found = language_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
