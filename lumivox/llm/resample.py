"""Documents drawn by how much they look like a target, with n-gram features in hashed buckets.

Each batch of documents has a dictionary of its distinct n-grams. Summed over
all batches these give one dictionary of the corpus, in which each n-gram is
hashed once; its buckets' shares in corpus and target give a gain for each n-gram, which
the batches then ask for. A document's weight is the mean of its gains; the
draw without replacement takes the highest sums of weight and Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm import batches
from lumivox.llm.common import discard, small_batches, written

#: Bytes that hold no word, as white space: ASCII but digits and letters; A-Z in lower case.
LOWER = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
COUNTED = "doc_id long, batch long, n_words long, n_features long, ids binary, times binary, feature array<string>, n array<long>"


@dataclass(frozen=True)
class Options:
    """longest: words of the longest n-gram; scale: of the integer gains; per_cent: of the documents with least_words that are drawn."""

    longest: int = 1
    buckets: int = 10_000
    scale: int = 1000
    least_words: int = 20
    per_cent: int = 10
    seed: int = 2024


class Places(dict):
    """Numbers n-grams in the order they come."""

    def __missing__(self, gram: bytes) -> int:
        at = self[gram] = len(self)
        return at


def grams(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """The text's number of words, and its runs of 1 to `longest` words."""
    words = (text or "").encode().translate(LOWER).split()
    return len(words), words + [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)]


def counted(texts: DataFrame, o: Options) -> DataFrame:
    """Each row's distinct n-grams, by place in its batch's dictionary, with counts; a batch's first row holds the dictionary and its counts.

    texts: (doc_id, text). A null text has no words.
    """
    small_batches(texts.sparkSession)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = batches.numbers()
        for b in got:
            places, n_words, n, ids, times = Places(), [], [], [], []
            total = np.zeros(0, np.int64)
            for t in b.column(1).to_pylist():
                words, found = grams(t, o.longest)
                at, c = np.unique(np.fromiter(map(places.__getitem__, found), np.int32), return_counts=True)
                if len(places) > len(total):
                    total = np.concatenate([total, np.zeros(2 * len(places) - len(total), np.int64)])
                total[at] += c
                n_words.append(words), n.append(len(found)), ids.append(batches.planes(np.diff(at, prepend=0))), times.append(batches.planes(c))
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([next(numbers)] * rows, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary()),
                 batches.first_row(pa.array([g.decode() for g in places], pa.string()), rows), batches.first_row(pa.array(total[: len(places)]), rows)],
                ["doc_id", "batch", "n_words", "n_features", "ids", "times", "feature", "n"],
            )

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def dictionary(own: DataFrame, target: DataFrame, o: Options) -> DataFrame:
    """feature, s, t and bucket of every distinct n-gram of either side: how often both have it, and the bucket of its bytes."""
    zero = F.lit(0).cast("long")
    both = own.select("feature", F.col("n").alias("s"), zero.alias("t")).union(target.select("feature", zero.alias("s"), F.col("n").alias("t")))
    return both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % o.buckets)


def gains(features: DataFrame, o: Options) -> DataFrame:
    """bucket and gain, a row for each bucket in use."""
    buckets = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = buckets.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = float(total.s or 0), float(total.t or 0)
    ratio = ((F.col("t") + 1) * F.lit(s + o.buckets)) / ((F.col("s") + 1) * F.lit(t + o.buckets))
    return buckets.select("bucket", F.floor(o.scale * F.ln(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs, and `row`, a number of its own; a table in the shared folder.

    docs: (doc_id, text), target: (text). weight is the floored mean of the gains of the row's n-grams, repeats counted, 0 without any.
    Null texts have no words; null ids and repeated rows stay; other columns are ignored.
    """
    rows = written(counted(docs, o), "resample-rows")
    wanted = written(counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), o), "resample-target")
    ask = batches.asked(rows, "feature", "n")
    known = written(dictionary(ask, batches.asked(wanted, "feature", "n"), o), "resample-dictionary")
    gain = written(gains(known, o), "resample-gains")
    # a row a bucket at most
    answers = ask.select("batch", "at", "feature").join(known.where("s > 0").select("feature", "bucket"), "feature").join(F.broadcast(gain), "bucket").select("batch", "at", "gain")

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        gain = np.zeros(answers.num_rows, np.int64)
        gain[answers["at"].to_numpy()] = answers["gain"].to_numpy()
        sums = [int(gain[np.cumsum(batches.from_planes(i))] @ batches.from_planes(n)) for i, n in zip(part["ids"].to_pylist(), part["times"].to_pylist())]
        weight = [s // n if n else 0 for s, n in zip(sums, part["n_features"].to_pylist())]
        out = part.select(["doc_id", "n_words", "n_features"]).append_column("weight", pa.array(weight, pa.int64()))
        return out.append_column("row", pc.add(part["batch"], pa.array(range(part.num_rows), pa.int64())))

    schema = "doc_id long, n_words long, n_features long, weight long, row long"
    out = written(batches.answered(rows.drop("feature", "n"), answers, run, schema), "resample-weights")
    discard(rows, wanted, known, gain)
    return out


def noise(doc_id, o: Options):
    """Gumbel noise of a document, in the scale of the gains, floored; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{o.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-o.scale * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, o: Options = Options()) -> DataFrame:
    """Adds score and rank to every row of `weighed`; rank is null where the row isn't drawn.

    Scores are integers of bounded range, so their counts tell which score is the last to be drawn; rows from there up are
    dealt to tasks by range and numbered there, and what stands before each task is added. Equal scores go by doc_id, null ids first, then by row.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), o)).withColumn("fit", F.col("n_words") >= o.least_words)
    by_score = scored.where("fit").groupBy("score").count().collect()  # as many as there are integers between the bounds of weight and noise
    left = math.floor(o.per_cent * sum(r["count"] for r in by_score) / 100)
    drawn, last = left, None
    for r in sorted(by_score, key=lambda r: -r.score):
        if left <= 0:
            break
        last, left = r.score, left - r["count"]
    null = F.lit(None).cast("long")
    if last is None:
        return scored.withColumn("rank", null).drop("fit")
    chosen = F.col("fit") & (F.col("score") >= last)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    placed = scored.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"task": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}), "resample-order")
    sizes = sorted(tuple(r) for r in placed.groupBy("task").count().collect())  # a row a task
    before, starts = 0, []
    for task, n in sizes:
        starts.append((task, before))
        before += n
    starts = placed.sparkSession.createDataFrame(starts, "task long, start long")
    ranked = placed.join(F.broadcast(starts), "task").withColumn("rank", F.col("start") + F.col("place") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = [*weighed.columns, "score", "rank"]
    return ranked.select(*names).union(scored.where(~chosen).withColumn("rank", null).select(*names))


def resample(docs: DataFrame, target: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs: 1, 2, 3, ... for those drawn, in the order of their scores, null for others.

    Empty tables give no rows; an empty target leaves all gains to the corpus alone.
    """
    return draw(weigh(docs, target, o), o).select("doc_id", "n_features", "weight", "score", "rank")
