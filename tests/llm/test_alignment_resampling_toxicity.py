"""Tokenizer alignment, importance resampling and toxicity: brute force, held-out accuracy, and null, empty, long, tied and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivox.llm import align, resample, toxicity
from lumivox.llm.common import held_out, table
from lumivox.llm.queries import OP12_SQL, tokenizer_file

SCHEMA = "doc_id long, text string, batch string, weight string, row string, score string, links string"
TEXTS = [
    "The river runs. It's 1984 again!", "naïve café — 中文字 😀 Straße", None, "", " ", "\n\n  \t", "<|endoftext|> stays text, so does </s>", "a mark ▁ that a piece model reads as a space",
    "x" * 3000, "word " * 5000, " " * 150_000 + "end", "The river runs. It's 1984 again!", "\x00 nul and \x7f", "é combining", "tabs\tand  two spaces",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, *"xxxxx") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], *"xxxxx"), (None, TEXTS[1], *"xxxxx"), (None, None, *"xxxxx")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# alignment


def plain_alignment(texts):
    """Results of each text in order, by both libraries and one step a token."""
    import sentencepiece
    from tokenizers import Tokenizer

    from lumivox.llm.bpe import _byte_chars

    a_file = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    of = _byte_chars()
    a_bytes = {i: bytes(of[c] for c in t) for t, i in a_file.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(i):
        piece = b_file.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    out = []
    for t in texts:
        a = [(i, a_bytes[i]) for i in a_file.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_file.encode(t or "")]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append((0, 0, [], ""))
            continue
        groups, links, i, j, left, right = [], [], 0, 0, b"", b""
        while i < len(a) or j < len(b):
            first, second = [], []
            while not first or len(left) != len(right):
                if len(left) <= len(right):
                    first.append(a[i][0])
                    left, i = left + a[i][1], i + 1
                else:
                    second.append(b[j][0])
                    right, j = right + b[j][1], j + 1
            links.append((first[-1], second[-1]))
            groups.append(",".join(map(str, first)) + "|" + ",".join(map(str, second)))
            left = right = b""
        out.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_alignment_equals_plain_loops(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    plain = plain_alignment([t for _, t in rows])
    counts = Counter(x for _, _, links, _ in plain for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(i, na, nb, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), digest) for (i, _), (na, nb, x, digest) in zip(rows, plain)]
    got = align.summary(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    assert got.dtypes == [*((c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert sum(w[1] == 0 for w in want) == 4  # null twice, empty, the mark
    assert align.summary(docs.limit(0), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_pair_counts_know_the_best_of_each_side(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog and the end of the day " * 3)], "doc_id long, text string")
    aligned = align.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).persist()
    pairs = align.pair_counts(aligned).collect()
    for side in "ab":
        most = Counter()
        for r in pairs:
            most[r[side]] = max(most[r[side]], r.links)
        assert all(r[f"best_{side}"] == (r.links == most[r[side]]) for r in pairs)
    text = aligned.first().groups
    assert [len(g.split("|")) for g in text.split(";")] == [2] * sum(r.links for r in pairs)
    aligned.unpersist()


# resampling


def plain_resample(rows, target, o=resample.Options()):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def grams(t):
        w = word.findall(lower(t))
        return w, [" ".join(w[i : i + n]) for n in range(1, o.longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % o.buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, grams(x)[1]))
    for x in target:
        t.update(map(bucket, grams(x)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(o.scale * math.log((t[b] + 1) * (n_s + o.buckets) / ((s[b] + 1) * (n_t + o.buckets))))
    out = []
    for i, x in rows:
        words, found = grams(x)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{o.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-o.scale * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    fit = sorted((r for r in out if r[4] >= o.least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = o.per_cent * len(fit) // 100
    return [tuple(r[:4]) for r in out], [(r[0], r[3]) for r in fit[:drawn]]


@pytest.mark.parametrize("o", [resample.Options(), resample.Options(longest=3, buckets=97, least_words=2, per_cent=60)])
def test_resampling_equals_plain_loops(spark, docs, o):
    target = ["river runs again", "word word", None, "中文字 café"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own, drawn = plain_resample(rows, target, o)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), o).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(own, key=order)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.doc_id, r.score) for r in ranked] == drawn


def test_resampling_of_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(5, "one two three " * 10)] * 40, "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    ranks = [r["rank"] for r in resample.resample(same, empty).collect()]
    assert sorted(x for x in ranks if x) == [1, 2, 3, 4] and len(ranks) == 40
    assert resample.resample(empty, same).count() == 0


def test_resampling_equals_its_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = resample.resample(table(spark, at, "documents"), table(spark, at, "benchmark")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select {', '.join(names)} from ({OP12_SQL})").fetchall())


# toxicity


def test_toxicity_finds_held_out_rows_and_leaves_clean_ones(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    rows = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = sum(r.toxic and r.predicted for r in rows) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted and not r.toxic for r in rows) / sum(not r.toxic for r in rows)
    assert caught > 0.9 and wrong < 0.005


def test_label_model_knows_accuracies_and_counts_copies_once():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    rates = [(0.7, 0.02), (0.5, 0.01), (0.6, 0.05), (0.1, 0.1)]
    votes = [np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates]
    votes += [votes[3]] * 3  # a useless voter, four times
    label = y ^ (rng.random(len(y)) < 0.03)
    quiet = ~(votes[0] | votes[1] | votes[2])
    found = toxicity.label_model(np.stack([*votes, quiet, ~label, label], 1).astype(float), 0.05 + 0.9 * label)
    for k, (a, b) in enumerate(rates):
        assert abs(found.speaks[k, 1] - a) < 0.08 and abs(found.speaks[k, 0] - b) < 0.02
        assert abs(found.accuracy[k] - 0.2 * a / (0.2 * a + 0.8 * b)) < 0.05
    assert max(found.weight[3:7]) < 0.3 < 0.9 < min(found.weight[:3])
    assert ((found.posterior > 0.5) == y).mean() > (label == y).mean()  # votes mend labels


def test_toxicity_of_odd_rows(spark, docs):
    schema = "doc_id long, toxic int, quality string"
    labels = spark.createDataFrame([(0, 0, "q"), (1, 1, "q"), (1, 0, "q"), (2, 1, "q"), (3, 7, "q"), (8, None, "q"), (None, 1, "q"), (9, 1, "q"), (404, 1, "q")], schema)
    got = toxicity.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in rows)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_never_reads_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.terms == b.terms and np.array_equal(a.weight, b.weight) and a.bias == b.bias
