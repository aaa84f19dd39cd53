"""Lines deduplicated across all documents, exactly and within one edited word.

A deletion neighbourhood over words: a line and all that it becomes when one
word is deleted are keys; two lines within one edit share such a key, at the
same place for a substituted word. Keys are only made for lines that need them: if
one word differs, either the first or the second half is equal, so lines whose
halves no other line has cannot have a partner, and words are deleted from the
unequal half alone. Groups are reduced to their earliest line, never paired up.
DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.llm.common import written

FLAGS = 62  # line flags in one long


@dataclass(frozen=True)
class Options:
    """least_words: lines of fewer words are compared exactly only. filter_bits bounds the filter that is sent to tasks."""

    least_words: int = 8
    filter_bits: int = 1 << 27


def _hashed_words(line: Column) -> Column:
    words = F.split(F.lower(F.translate(line, "\t\x0b\f\r", "    ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _lines(docs: DataFrame, where: Column | None = None) -> DataFrame:
    """doc_id, line (from 0), n and words (as hashes) of each line that has a word; where: a test of doc_id and line made before words are."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if where is not None:
        raw = docs.select(doc_id, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "of")).where(where)
        at = raw.select("doc_id", "line", F.explode(F.array(_hashed_words(F.col("of")))).alias("words"))
    else:
        # the words come out of the generator, so no later filter computes them again
        at = docs.select(doc_id, F.posexplode(F.transform(F.split(F.col("text").cast("string"), "\n"), _hashed_words)).alias("line", "words"))
    return at.withColumn("n", F.size("words")).where("n > 0")


def _halves() -> Column:
    """The line's equal-half keys, as an array of (key, kind, rest): for partners as long or one longer, then one shorter.

    kind 0: substitution or this line the shorter one; kind 1: this line the longer one. rest: the words outside the half.
    """
    out = []
    for kind in (0, 1):
        m = F.col("n") - kind  # words of the shorter one of two
        p = F.floor(m / 2).cast("int")
        s = (m - p).cast("int")
        for side, half, rest in ((0, F.slice("words", F.lit(1), p), F.slice("words", p + 1, F.col("n") - p)), (1, F.slice("words", F.col("n") - s + 1, s), F.slice("words", F.lit(1), F.col("n") - s))):
            out.append(F.struct(F.xxhash64(F.lit(side), m, half).alias("key"), F.lit(kind).alias("kind"), rest.alias("rest")))
    return F.array(*out)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _keys() -> Column:
    return F.array(*[_halves()[i].key for i in range(4)])


def _shared_halves(distinct: DataFrame) -> DataFrame:
    """Keys of halves that more than one distinct line has."""
    return distinct.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > 1).select("key")


def _places(key: Column, bits: int) -> list[Column]:
    """A key's two places in a bitmap of `bits`, a power of two up to 2^31."""
    return [key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 33).bitwiseAND(bits - 1)]


def _filter_of(keys: DataFrame, bits: int) -> DataFrame:
    """One row: a bitmap of both places of the keys, whose size depends on `bits` alone."""
    at = keys.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("at"))
    some = at.select(F.shiftright("at", 6).alias("w"), _bit(F.col("at").bitwiseAND(63)).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    whole = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(some, "w", "left")
    rows = F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return whole.agg(F.transform(rows, lambda x: x.b).alias("bits"))


def _in_filter(bitmap: Column, key: Column, bits: int) -> Column:
    """Whether both places of the key are set; a subquery may not stand inside a lambda, so this takes one key."""
    set_at = lambda p: F.get(bitmap, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p.bitwiseAND(63))) != 0
    p, q = _places(key, bits)
    return set_at(p) & set_at(q)


def _bits_for(n: int, o: Options) -> int | None:
    """The size of a filter of n keys, None beyond the bound."""
    bits = 1 << max(16, (32 * n).bit_length())
    return bits if bits <= o.filter_bits else None


def _passing(distinct: DataFrame, keys: DataFrame, o: Options) -> DataFrame:
    """doc_id, line and `hits` (for each half whether others have it) of the distinct lines with a hit; some more pass by chance.

    Beyond the filter's bound the lines are found by a join, exactly those.
    """
    bits = _bits_for(keys.count(), o)
    if bits:
        bitmap = _filter_of(keys, bits).scalar()
        hits = [_in_filter(bitmap, F.get("keys", F.lit(i)), bits) for i in range(4)]
        return distinct.select("doc_id", "line", F.array(*hits).alias("hits")).where(F.array_contains("hits", True))
    own = distinct.select("doc_id", "line", F.posexplode("keys").alias("i", "key")).join(keys, "key", "left_semi")
    mine = own.groupBy("doc_id", "line").agg(F.collect_set("i").alias("of"))
    return mine.select("doc_id", "line", F.array(*[F.array_contains("of", i) for i in range(4)]).alias("hits"))


def split_by_ids(docs: DataFrame, ids: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose doc_id may be among `ids` (doc_id), and those whose surely isn't, so that the latter's texts need no shuffle.

    Through a filter of bounded size; beyond its bound all rows are in the first part.
    """
    bits = _bits_for(ids.count(), o)
    if not bits:
        return docs, docs.limit(0)
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    may = F.coalesce(_in_filter(_filter_of(ids.select(hashed.alias("key")), bits).scalar(), hashed, bits), F.lit(False)) & F.col("doc_id").isNotNull()
    return docs.where(may), docs.where(~may)


def _survivors(docs: DataFrame, passing: DataFrame, o: Options) -> DataFrame:
    """The passing lines with their words, from a second look at the texts."""
    first = written(passing.select(F.col("doc_id").alias("of"), F.col("line").alias("no"), "hits"), "lines-passing")
    bits = _bits_for(first.count(), o)
    place = lambda d, i: F.xxhash64(d, i)
    test = _in_filter(_filter_of(first.select(place("of", "no").alias("key")), bits).scalar(), place("doc_id", "line"), bits) if bits else None
    lines = _lines(docs, test)
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("line") == F.col("no"))
    # rows that share a doc_id may repeat a line's place
    # hinted, as `first` is written in a small part of its size in memory
    return written(lines.join(first.hint("merge"), same).select("doc_id", "line", "n", "words", "hits").dropDuplicates(["doc_id", "line", "words"]), "lines-survivors")


def _without(a: Column, i: Column) -> Column:
    """The array a without its element i, from 0."""
    return F.concat(F.slice(a, F.lit(1), i), F.slice(a, i + 2, F.size(a) - i - 1))


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """k1, k2, deleted, doc_id, line: the lines' keys; k1 of the equal half, k2 of the rest, whole or with a word deleted.

    Substitutions keep the place in k2, so all with one key are within one edit
    of each other; else one line has the key whole, and those with a word deleted are within one edit of it.
    """
    each = lines.select("doc_id", "line", "hits", F.posexplode(_halves()).alias("i", "x")).where(F.get("hits", "i")).select("doc_id", "line", "x.*")
    places = F.sequence(F.lit(0), F.size("rest") - 1)
    cut = lambda i: F.struct(F.xxhash64(F.when(F.col("kind") == 0, i).otherwise(-1), _without(F.col("rest"), i)).alias("k2"), F.lit(True).alias("deleted"))
    whole = F.array(F.struct(F.xxhash64(F.lit(-1), F.col("rest")).alias("k2"), F.lit(False).alias("deleted")))
    keys = F.when(F.col("kind") == 0, F.concat(whole, F.transform(places, cut))).otherwise(F.transform(places, cut))
    return each.select("doc_id", "line", F.col("key").alias("k1"), F.explode(keys).alias("k")).select("k1", "k.k2", "k.deleted", F.struct("doc_id", "line").alias("at"))


def _earlier_partners(survivors: DataFrame) -> DataFrame:
    """(at, partner): lines with an earlier line that shares a key; at and partner are (doc_id, line)."""
    v = _neighbourhood(survivors)
    groups = v.groupBy("k1", "k2").agg(F.min(F.when(~F.col("deleted"), F.col("at"))).alias("whole"), F.min(F.when(F.col("deleted"), F.col("at"))).alias("first"), F.max(F.when(F.col("deleted"), F.col("at"))).alias("last"), F.sum(F.col("deleted").cast("int")).alias("n"), F.count(F.lit(1)).alias("all"))
    groups = written(groups.where("all > 1 and (first <> last or whole is not null)"), "lines-groups")
    # the place is in the key of a substitution, so no whole line shares it
    two = F.array(F.struct(F.col("first").alias("at"), F.coalesce("whole", "first").alias("partner")), F.struct(F.col("last").alias("at"), F.coalesce("whole", "first").alias("partner")), F.struct(F.col("whole").alias("at"), F.col("first").alias("partner")))
    out = groups.select(F.explode(two).alias("x")).select("x.*")
    many = groups.where("n > 2").select("k1", "k2", F.coalesce("whole", "first").alias("partner"))
    if not many.isEmpty():
        out = out.union(v.where("deleted").join(many, ["k1", "k2"]).select("at", "partner"))
    return out.where("partner < at").distinct()


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are one substituted, inserted or deleted word apart, or equal."""

    def one_more(x: Column, y: Column) -> Column:
        same = F.array_position(F.zip_with(F.slice(x, F.lit(1), F.size(y)), y, lambda p, q: p == q), False) - 1
        lead = F.when(same < 0, F.size(y)).otherwise(same).cast("int")
        return F.slice(x, lead + 2, F.size(x) - lead - 1) == F.slice(y, lead + 1, F.size(y) - lead)

    differ = F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda d: d))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(a) == F.size(b) + 1, one_more(a, b)).when(F.size(b) == F.size(a) + 1, one_more(b, a)).otherwise(False)


def dedup_lines(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """docs with `text` rid of repeated lines, and n_lines and n_removed.

    Lines are equal if their words are, lower-cased and whatever the white
    space. A line goes if an equal line, or for lines of least_words or more one
    within one edited word, stands earlier by (doc_id, line number); whether
    that one stays itself doesn't matter. Lines without a word stay. A null
    text stays null with 0 lines; a null doc_id comes before all others. Rows
    that share a doc_id count as one document: a line that they share at one
    place stays or goes in all of them. All other columns stay, but for old ones named n_lines and
    n_removed; an empty table gives no rows.
    """
    lines = _lines(docs).withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")})
    lines = lines.select("h1", "h2", F.struct("doc_id", "line").alias("at"), F.when(F.col("n") >= o.least_words, _keys()).alias("keys"))
    distinct = lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("keys").alias("keys"))
    distinct = written(distinct.select("at.doc_id", "at.line", "keys"), "lines-distinct")
    long = distinct.where("keys is not null")
    passing = _passing(long, written(_shared_halves(long), "lines-halves"), o)
    survivors = _survivors(docs, passing, o)
    pairs = _earlier_partners(survivors)
    own, other = (survivors.select(F.struct("doc_id", "line").alias(f"{p}_at"), F.col("words").alias(f"{p}_words")) for p in ("own", "other"))
    pairs = pairs.join(own, pairs["at"].eqNullSafe(own.own_at)).join(other, F.col("partner").eqNullSafe(other.other_at))
    gone = pairs.where(_within_one_edit(F.col("own_words"), F.col("other_words"))).select("at").distinct()
    kept = distinct.select("doc_id", "line").join(gone.select(F.col("at.doc_id").alias("of"), F.col("at.line").alias("no")), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("line") == F.col("no")), "left_anti")
    flags = kept.groupBy("doc_id", F.floor(F.col("line") / FLAGS).alias("w")).agg(F.bit_or(_bit(F.col("line") % FLAGS)).alias("b"))
    flags = flags.groupBy(F.col("doc_id").alias("_kept_of")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("int"), "b"))).alias("_kept_at"))
    all_lines = F.split(F.col("text").cast("string"), "\n")

    def stays(line: Column, i: Column) -> Column:
        b = F.coalesce(F.try_element_at("_kept_at", F.floor(i / FLAGS).cast("int")), F.lit(0).cast("long"))
        return (b.bitwiseAND(_bit(i % FLAGS)) != 0) | ~line.rlike(r"\S")

    joined = docs.drop("n_lines", "n_removed").join(flags, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_of")), "left")
    joined = joined.withColumn("_kept_at", F.coalesce("_kept_at", F.expr("cast(map() as map<int, bigint>)")))
    left = F.filter(all_lines, stays)
    out = joined.withColumns({"n_lines": F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1, "_left": left})
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    return out.withColumns({"text": F.coalesce(F.array_join("_left", "\n"), "text"), "n_removed": F.coalesce(F.col("n_lines") - F.size("_left"), F.lit(0))}).drop("_left", "_kept_at", "_kept_of")
