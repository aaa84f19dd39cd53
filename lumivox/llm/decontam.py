"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index is searched by block-max WAND. Scores are divided by an item's least
possible score over passages that hold enough of its word shingles, so a
threshold of 1 loses no passage that the overlap check would accept.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.common import filesystem, scratch, small_batches, written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
EXPANDED = 1 << 20  # marked postings looked at together
FOUND = "doc_id long, item_id long, passage long, bm25 double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: what stands after the last question mark or an answer label is the answer, if anything does."""
    label = list(re.finditer(r"(?im)^\s*(?:answer|a)\s*:", text))
    cut = label[-1].end() if label else text.rfind("?") + 1
    question, answer = words(text[: label[-1].start()] if label else text[:cut]), words(text[cut:])
    return (question, answer) if question and answer else (words(text), [])


def shingles(w: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def overlap(part: list[str], passage: set[tuple[str, ...]], passage_words: list[str], n: int) -> float:
    """The share of part's distinct n-word shingles in the passage; a part of fewer words counts if it stands there whole."""
    if len(part) >= n:
        own = shingles(part, n)
        return len(own & passage) / len(own)
    k = len(part)
    return float(k > 0 and any(passage_words[i : i + k] == part for i in range(len(passage_words) - k + 1)))


def passage_words(n_words: int) -> int:
    """Words of the passages in which an item of so many words is looked for: room for as many others, 64 at least."""
    return max(64, 2 * n_words)


def best_run(parts: list[list[str]], w: list[str], length: int, share: float, n: int) -> tuple[int, float, float | None] | None:
    """Of all runs of `length` words of w that hold enough of each part, the one that holds most: its first word and the overlaps.

    Runs that begin at a shingle of a part are enough, as any other holds no more than the next of them.
    """
    events, size = [], []  # (first word, word after the last, part, shingle)
    for p, part in enumerate(parts):
        k = min(n, len(part))
        own = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        size.append(len(own))
        events += [(i, i + k, p, t) for i in range(len(w) - k + 1) if (t := tuple(w[i : i + k])) in own]
    held: list[Counter] = [Counter() for _ in parts]
    ends, e, best = sorted(events, key=lambda x: x[1]), 0, None
    for start, _, p, t in sorted(events, key=lambda x: x[0]):
        while e < len(ends) and ends[e][1] <= start + length:
            held[ends[e][2]][ends[e][3]] += 1
            e += 1
        of = [len(h) / m for h, m in zip(held, size)]
        if all(x >= share for x in of) and (best is None or sum(of) > sum(best[1:])):
            best = (start, *of)
        held[p][t] -= 1
        if not held[p][t]:
            del held[p][t]
    return best and (best[0], best[1], best[2] if len(best) > 2 else None)


def shingle_counts(w: list[str], n: int) -> list[int]:
    """How often each distinct shingle stands in w, most frequent first."""
    return sorted(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values(), reverse=True)


def hideable(weights: list[float], counts: list[int], share: float, n: int) -> float:
    """The largest sum of word weights that can be missing while `share` of the distinct shingles are there.

    A word can be missing only if all the shingles over it are. State: places
    lacking a shingle so far, and how many of them in a row, where those
    beyond the ends count as lacking.
    """
    missing = sum(counts[: math.floor((1 - share) * len(counts) + 1e-9)])
    if not missing:
        return 0.0
    state = {(0, n - 1): 0.0}
    for p in range(len(weights)):
        beyond, after = p > len(weights) - n, {}
        for (used, run), total in state.items():
            if not beyond:
                after[used, 0] = max(after.get((used, 0), 0.0), total)
            if beyond or used < missing:
                key, t = (used + (not beyond), min(run + 1, n)), total + (weights[p] if run + 1 >= n else 0.0)
                after[key] = max(after.get(key, 0.0), t)
        state = after
    return max(state.values())


class Index:
    """Postings of one block of items, impacts scaled to a threshold of 1, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, share: float, n: int, block: int = 32):
        self.ids, self.n, self.share = [i for i, _ in items], n, share
        self.parts = [question_answer(t) for _, t in items]
        self.length = [passage_words(len(q) + len(a)) for q, a in self.parts]
        self.longest = max([1, *self.length])
        self.scale, self.weight, postings = [], [], defaultdict(list)
        for k, (question, answer) in enumerate(self.parts):
            w = question + answer  # an answer label is in neither, a passage may leave it out
            weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean_words)) for t, c in Counter(w).items()}
            least = self._least(k, weight)
            self.scale.append(least)
            self.weight.append(weight)
            for t, x in weight.items():
                postings[t].append((k, x / least))
        self.term = {t: i for i, t in enumerate(postings)}
        self.post = [[k for k, _ in p] for p in postings.values()]
        self.impact = [[x for _, x in p] for p in postings.values()]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in self.post])]).astype(np.int64)
        self.block = block
        self.block_max = [[max(x[i : i + block]) for i in range(0, len(x), block)] for x in self.impact]
        self.upper = [max(x) for x in self.impact]
        self._pivots()

    def _pivots(self, common: float = 0.5) -> None:
        """Marks the postings that can be an item's pivot; the most widespread terms can't, while their impacts come to `common` or less.

        Only a passage whose marked postings of an item reach 1 less those impacts can reach 1, so WAND need go no further for others.
        """
        item = np.concatenate([np.array(p, dtype=np.int64) for p in self.post])
        impact = np.concatenate([np.array(x) for x in self.impact])
        term = np.repeat(np.arange(len(self.post)), np.diff(self.start))
        order = np.lexsort((term, impact, -np.diff(self.start)[term], item))
        first = np.flatnonzero(np.diff(item[order], prepend=-1))
        so_far = np.cumsum(impact[order])
        so_far -= np.repeat(so_far[first] - impact[order][first], np.diff([*first, len(order)]))
        pivot = np.ones(len(item), bool)
        pivot[order] = so_far > common
        # the marked postings alone, by term
        self.marked_item, self.marked_impact = item[pivot], impact[pivot]
        self.marked_start = np.concatenate([[0], np.cumsum(np.bincount(term[pivot], minlength=len(self.post)))]).astype(np.int64)
        self.need = 1 - np.bincount(item[~pivot], impact[~pivot], minlength=len(self.ids))

    def _least(self, k: int, weight: dict[str, float]) -> float:
        """What a passage scores at least that passes the check: all terms but the dearest that the missing shingles can hide."""
        times = Counter(t for part in self.parts[k] for t in part)
        hidden = sum(hideable([weight[t] / times[t] for t in part], shingle_counts(part, self.n), self.share, self.n) for part in self.parts[k])
        return max(sum(weight.values()) - hidden, 1e-9) * (1 - 1e-9)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a scaled score of 1 or more for the distinct terms, by block-max WAND."""
        lists = [[self.post[t][0], t, 0] for t in terms]  # current item, term, position
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(lists):
                bound += self.upper[t]
                if bound >= 1:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = [self._shallow(t, at, item) for _, t, at in lists[: pivot + 1]]
            if sum(m for m, _ in ahead) < 1:  # no item before the nearest block's end can reach the threshold
                to = min([e for _, e in ahead] + ([lists[pivot + 1][0]] if pivot + 1 < len(lists) else []))
                self._advance(lists, pivot + 1, max(to, item + 1))
            elif lists[0][0] == item:
                total = sum(self.impact[t][at] for _, t, at in lists[: pivot + 1])
                if total >= 1:
                    found.append((item, total))
                self._advance(lists, pivot + 1, item + 1)
            else:
                self._advance(lists, pivot, item)
            lists = [x for x in lists if x[0] is not None]
        return found

    def _shallow(self, t: int, at: int, item: int) -> tuple[float, int]:
        """Largest impact of the block that would hold the item, and the first item after that block."""
        post, b = self.post[t], at // self.block
        while (b + 1) * self.block < len(post) and post[(b + 1) * self.block - 1] < item:
            b += 1
        end = min((b + 1) * self.block, len(post))
        return (self.block_max[t][b], post[end - 1] + 1) if post[end - 1] >= item else (0.0, 1 << 62)

    def _advance(self, lists: list, n: int, item: int) -> None:
        for x in lists[:n]:
            post, at = self.post[x[1]], x[2]
            while at < len(post) and post[at] < item:
                at = (at // self.block + 1) * self.block if (at // self.block + 1) * self.block <= len(post) and post[min(len(post), (at // self.block + 1) * self.block) - 1] < item else at + 1
            x[0], x[2] = (post[at] if at < len(post) else None), at

    def pivot_step(self, texts: list[list[str]], step: int) -> dict[int, list[int]]:
        """WAND's first step for all passages of some texts at once, over the marked postings: by text, the passages that have a pivot.

        Passage p of a text has its words from p * step on, 2 * step of them.
        """
        n = np.array([len(w) for w in texts], dtype=np.int64)
        ids = np.fromiter((self.term.get(x, -1) for w in texts for x in w), dtype=np.int64, count=int(n.sum()))
        chunks = -(-n // step)
        first = np.cumsum(chunks) - chunks
        text = np.repeat(np.arange(len(texts)), n)
        chunk = first[text] + (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)) // step
        pairs = np.unique(chunk[ids >= 0] * len(self.post) + ids[ids >= 0])
        chunk, term = pairs // len(self.post), pairs % len(self.post)
        count = self.marked_start[term + 1] - self.marked_start[term]
        chunk, term, count = chunk[count > 0], term[count > 0], count[count > 0]
        owner, total = np.repeat(np.arange(len(texts)), chunks), int(chunks.sum())
        begin = np.searchsorted(chunk, np.arange(total + 1))
        before = np.concatenate([[0], np.cumsum(count)])[begin]  # postings of the chunks before each
        out, low = defaultdict(list), 0
        while low < total:
            # passages from `low` on, and the chunk after the last of them, whose postings come to EXPANDED at most where more than one passage is left
            high = min(total, max(low + 1, int(np.searchsorted(before, before[low] + EXPANDED, "right")) - 2))
            some = slice(begin[low], begin[min(total, high + 1)])
            for p in self._reached(chunk[some], term[some], count[some], first, owner, low, high):
                out[int(owner[p])].append(int(p - first[owner[p]]))
            low = high
        return out

    def _reached(self, chunk: np.ndarray, term: np.ndarray, count: np.ndarray, first: np.ndarray, owner: np.ndarray, low: int, high: int) -> np.ndarray:
        """Passages low to high whose marked postings of an item reach what it needs; one has its own chunk's and the next one's."""
        row = np.repeat(np.arange(len(term)), count)
        at = self.marked_start[term][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        item, impact, chunk = self.marked_item[at], self.marked_impact[at], chunk[row]
        here, ahead = chunk < high, (chunk > low) & (chunk != first[owner[chunk]])  # a text's first chunk is in no passage before it
        key = np.concatenate([chunk[here], chunk[ahead] - 1]) * len(self.ids) + np.concatenate([item[here], item[ahead]])
        key, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([impact[here], impact[ahead]]), minlength=len(key))
        return np.unique(key[total >= self.need[key % len(self.ids)] - 1e-6] // len(self.ids))

    def contaminated(self, split: list[list[str]]) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, passage's first word, BM25, overlap of question and of answer): the best passage for each item found.

        The search reads twice the longest passage's words from each multiple of that passage on; so each passage, wherever it
        begins, is in one of those. Items found there are checked on passages of their own length.
        """
        step, out = self.longest, []
        for k, found in self.pivot_step(split, step).items():
            best: dict[int, tuple] = {}
            for a in (p * step for p in found):
                part = split[k][a : a + 2 * step]
                for item, _ in self.search(sorted({self.term[x] for x in part if x in self.term})):
                    run = best_run([p for p in self.parts[item] if p], part, self.length[item], self.share, self.n)
                    if run:
                        score = sum(self.weight[item].get(t, 0.0) for t in set(part[run[0] : run[0] + self.length[item]]))
                        row = (k, item, a + run[0], score, run[1], run[2])
                        if item not in best or (-row[4] - (row[5] or 0), row[2]) < (-best[item][4] - (best[item][5] or 0), best[item][2]):
                            best[item] = row
            out += best.values()
        return out


def indexes(items: DataFrame, share: float, n: int, per_block: int) -> list[list[str]]:
    """Builds indexes of blocks of some per_block items, with counts over all items, in tasks; returns their files by block.

    What is sent to tasks at once is so bounded, and nothing of an item comes to the driver. A block has an index for each range of
    passage lengths, 64 words and then doubling: long items don't blur the search for short ones.
    """
    spark = items.sparkSession

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [words(t) for t in b["text"]]
            yield b.assign(w=w, range=[(passage_words(sum(map(len, question_answer(t)))) - 1).bit_length() for t in b["text"]])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    own = written(rows.mapInPandas(split, "item_id long, text string, w array<string>, range int").where(F.size("w") > 0), "decontam-items")
    n_items, mean = own.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    blocks = max(1, -(-n_items // per_block))
    terms = own.select("item_id", "text", "range", F.explode(F.array_distinct("w")).alias("t"))
    # hinted, as Spark takes an item's terms for one row
    told = terms.hint("merge").join(terms.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "t").groupBy("item_id", "text", "range").agg(F.collect_list("t").alias("t"), F.collect_list("df").alias("df"))
    out = scratch(spark, "decontam-indexes")
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "text"])
        df = {t: int(c) for ts, cs in zip(rows["t"], rows["df"]) for t, c in zip(ts, cs)}
        index = Index(list(zip(rows["item_id"].tolist(), rows["text"])), df, n_items, mean, share, n)
        path = f"{out}/{uuid.uuid4().hex}.index"  # a lost attempt's file is in no row
        fs, at = filesystem(path)
        with fs.open_output_stream(at) as f:
            f.write(pickle.dumps(index))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "range": rows["range"].iloc[:1], "path": [path]})

    files = told.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block", "range").applyInPandas(build, "block int, range int, path string")
    found = sorted(map(tuple, written(files, "decontam-files").collect()))
    return [[path for *_, path in block] for _, block in groupby(found, lambda x: x[0])]


def loaded(path: str) -> Index:
    """An index from its file."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return pickle.loads(f.read())


@lru_cache(maxsize=1)
def loaded_block(paths: tuple[str, ...]) -> list[Index]:
    """The indexes of a block, read once in each Python worker, which holds one block at a time."""
    return list(map(loaded, paths))


def find(docs: DataFrame, items: DataFrame, share: float = 0.8, shingle: int = 5, per_block: int = 20_000) -> DataFrame:
    """Documents that hold a test item: doc_id, item_id, passage, bm25, question_overlap, answer_overlap.

    One row per document and item: of its passages, which are all runs of twice
    the item's words (64 at least), with at least `share` of the question's and,
    where the item has one, of the answer's distinct shingles, the first that
    has most of both. What is found doesn't depend on other items or on where
    in the document a passage stands. answer_overlap is null for items without an
    answer of their own. Items with a null id or without a word are left out;
    repeated ones count once. Texts of any length are searched whole;
    null or empty texts hold nothing; rows with a null doc_id give rows with a
    null one, repeated rows give repeated rows, other columns are ignored.
    Items beyond per_block are indexed and searched block by block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in indexes(items, share, shingle, per_block):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            names = [x.split()[0] for x in FOUND.split(", ")]
            for b in batches:
                ids, split = b["doc_id"].tolist(), [words(t) for t in b["text"].tolist()]
                rows = [(ids[k], index.ids[i], *rest) for index in loaded_block(tuple(block)) for k, i, *rest in index.contaminated(split)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "answer_overlap": "float64"})

        part = texts.mapInPandas(run, FOUND)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], FOUND)
