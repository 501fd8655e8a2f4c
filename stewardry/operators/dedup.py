"""Duplicate detection of candidate names against active golden records.

A candidate meets every active record whose name contains its first four characters and
shares at least half of the words; only the reported list is cut to the best five.

Names of few words meet under the word sets they share. A record is filed under every set of
at least half of its words, a candidate looks up every set of at least half of its own. Under
one prefix, set and number of words all records score alike or better, so the lowest codes of
each are enough, and the work follows the number of names, not of pairs. Longer names are
filed under their rare words: two sets that share at least half of the larger one share one
of them, and a pair is scored under the first. The records of a key travel in chunks, and a
candidate's best of a chunk are picked inside the row. Pairs are never written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import once, unfold
from ..functions.text import grams, normalise, tokens, word_overlap
from ..session import materialize, scratch_path

#: names of at most so many words meet under shared word sets
WIDE = 8
#: records of one key that travel together; a key with more gets several chunks
CHUNK = 256
NO_WORD = ""
ITEMS = "items array<struct<code:string,raw_name:string>>"

Similarity = Callable[[Column, Column], Column]


def rounded(score: Column) -> Column:
    """Two decimals, ties as the score's binary value decides (the halves are m/200)."""
    halves = {m: round(m / 200, 2) for m in range(1, 201, 2)}
    exact = F.round(score * 200, 9)
    tie = (exact == F.floor(exact)) & (exact % 2 == 1)
    table = F.create_map(*[F.lit(x) for pair in halves.items() for x in pair])
    return F.when(tie, F.element_at(table, exact.cast("int"))).otherwise(F.bround(score, 2))


def active_names(golden: DataFrame) -> DataFrame:
    """``low, words, items``: the distinct names of active records in lower case, each with its
    five lowest codes (``items``: code, raw name).

    A list of five needs no more of a name, since all its records score alike. Of equal codes
    the lowest raw name counts; records without a code are never reported.
    """
    active = golden.filter(
        (F.col("status") == "active") & F.col("material_name").isNotNull() & F.col("material_code").isNotNull()
    )
    coded = active.groupBy(F.lower("material_name").alias("low"), F.col("material_code").alias("code")).agg(
        F.min("material_name").alias("raw_name")
    )
    nth = F.row_number().over(Window.partitionBy("low").orderBy("code"))
    first = coded.withColumn("_nth", nth).filter(F.col("_nth") <= C.TOP_HITS)
    names = first.groupBy("low").agg(F.sort_array(F.collect_list(F.struct("code", "raw_name"))).alias("items"))
    return names.select("low", tokens(F.col("low")).alias("words"), "items")


def filed(names: DataFrame) -> DataFrame:
    """``names`` once for every ``prefix`` that can ask for them: each run of four characters
    of a name, or the whole of a shorter one."""
    short = F.length("low") < C.PREFIX_CHARS
    prefixes = F.when(short, F.array("low")).otherwise(grams(F.col("low"), C.PREFIX_CHARS))
    return names.withColumn("prefix", F.explode(prefixes))


def candidate_names(candidates: DataFrame, name: str = "material_name") -> DataFrame:
    """Distinct searchable names with their words and prefix; equal names are scored once."""
    text = normalise(F.col(name))
    return (
        once(candidates, name=text)
        .filter(F.length("name") >= C.MIN_NAME_CHARS)
        .distinct()
        .withColumn("prefix", F.substring("name", 1, C.PREFIX_CHARS))
        .withColumn("words", tokens(F.col("name")))
    )


def postings_for(names: DataFrame, golden: DataFrame) -> DataFrame:
    """``prefix, low, words, items``: the filed records that ``names`` can ask for."""
    asked = names.select("prefix").distinct()
    return materialize(filed(active_names(golden)).join(asked, "prefix", "left_semi"))


def _exact_hits(names: DataFrame, postings: DataFrame) -> DataFrame:
    """``name, code, raw_name``: the five lowest codes of each name's equals."""
    same = postings.select("prefix", F.col("low").alias("name"), "items")
    return names.select("prefix", "name").join(same, ["prefix", "name"]).select("name", F.inline("items"))


def _searchable(names: DataFrame) -> DataFrame:
    """Names long enough for more than exact hits."""
    return names.filter((F.length("name") >= C.PREFIX_CHARS) & (F.size("words") > 0))


#: by number of words: the bit patterns of every set of at least half of them
MASKS = [[m for m in range(1, 1 << n) if 2 * m.bit_count() >= n] for n in range(WIDE + 1)]


def by_word_sets(names: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``size``, and one row for every ``set`` of at least half of a name's words, ``k``
    of them; names of more than WIDE words have none."""
    few = names.filter(F.size("words").between(1, WIDE)).withColumn("words", F.array_sort("words"))
    masks = F.element_at(F.array(*[F.array(*map(F.lit, m)).cast("array<int>") for m in MASKS[: WIDE + 1]]), F.size("words") + 1)
    each = unfold(few.withColumn("masks", masks), "masks", [*keep, "words"])
    chosen = F.expr("array_join(filter(words, (w, i) -> (shiftright(item, i) & 1) = 1), ' ')")
    return each.select(*keep, F.size("words").alias("size"), F.bit_count("item").alias("k"), chosen.alias("set"))


def _set_hits(names: DataFrame, postings: DataFrame, lowest_codes: int) -> DataFrame:
    """``name, code, raw_name, score`` for candidates and records of at most WIDE words: for
    every shared set of words and size of record the lowest codes.

    A record behind five others scores no better than they do and is none of the best. Where
    the candidate's equals do not count, ten are needed, since five may be equals. Under a
    smaller set than the one really shared a record's score is too low; it is then found under
    the larger one too, or is none of the best.
    """
    keys = materialize(by_word_sets(_searchable(names), ["name", "prefix"]).withColumnRenamed("size", "a"))
    asked = keys.select("prefix", "set").distinct()
    sets = by_word_sets(postings, ["prefix", "items"]).withColumnRenamed("size", "b").drop("k")
    entries = sets.join(asked, ["prefix", "set"], "left_semi").select("prefix", "set", "b", F.inline("items"))
    nth = F.dense_rank().over(Window.partitionBy("prefix", "set", "b").orderBy("code"))
    lowest = entries.withColumn("_nth", nth).filter(F.col("_nth") <= lowest_codes).drop("_nth")
    score = F.col("k") / F.greatest("a", "b")
    return (
        keys.join(lowest, ["prefix", "set"])
        .filter((score >= C.KEEP_SCORE) & (F.lower("raw_name") != F.col("name")))
        .select("name", "code", "raw_name", score.alias("score"))
    )


def with_rare_words(names: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Add ``rare``: of a name's n words the n - ceil(n / 2) + 1 rarest, rarest first."""
    words = names.select(key, F.explode("words").alias("word")).distinct().join(counts, "word", "left")
    ordered = words.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))).alias("_o")
    )
    size = F.size("_o")
    rare = F.slice(F.col("_o.word"), F.lit(1), (size - F.ceil(size / 2) + 1).cast("int"))
    return names.join(ordered.select(key, rare.alias("rare")), key)


def _best_of_chunk(similarity: Similarity, by_word: bool) -> Column:
    """The best records of a chunk as (score, code, raw name): the five best by score and code,
    and the five best by rounded score and code."""
    first_common = lambda g: F.get(F.array_intersect("rare", g.rare), F.lit(0)) == F.col("word")
    fits = lambda g: (g.low != F.col("name")) & (first_common(g) if by_word else F.lit(True))
    scored = F.transform(
        F.filter("items", fits), lambda g: F.struct(similarity(F.col("words"), g.words).alias("score"), g["items"].alias("items"))
    )
    kept = F.filter(scored, lambda g: g.score >= C.KEEP_SCORE)

    def best(rank: Callable[[Column], Column]) -> Column:
        ranked = F.transform(
            kept,
            lambda g: F.transform(
                g["items"],
                lambda c: F.struct((-rank(g.score)).alias("rank"), c.code.alias("code"), c.raw_name.alias("raw_name"), g.score.alias("score")),
            ),
        )
        return F.slice(F.sort_array(F.flatten(ranked)), 1, C.TOP_HITS)

    whole = F.transform(best(lambda x: x), lambda h: F.struct(h.code.alias("code"), h.raw_name.alias("raw_name"), h.score.alias("score")))
    round_ = F.transform(best(rounded), lambda h: F.struct(h.code.alias("code"), h.raw_name.alias("raw_name"), h.score.alias("score")))
    return F.array_distinct(F.concat(whole, round_))


def _chunk_hits(names: DataFrame, postings: DataFrame, similarity: Similarity) -> DataFrame:
    """``name, code, raw_name, score``: the best of every chunk.

    By words, only pairs of which one has more than WIDE words; another similarity is tried
    on all records that contain the prefix.
    """
    by_word = similarity is word_overlap
    names = _searchable(names)
    if by_word:
        # a record of few words meets long candidates only, of which half are five words
        wide = F.size("words") > WIDE
        postings = postings.withColumn("wide", wide).filter(F.col("wide") | (2 * F.size("words") > WIDE))
        asking = names.withColumn("wide", F.explode(F.when(wide, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
        counts = postings.select("low", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("uses"))
        keys = with_rare_words(asking, counts, "name").withColumn("word", F.explode("rare"))
        kept = with_rare_words(postings, counts, "low").withColumn("word", F.explode("rare"))
    else:
        extra = {"wide": F.lit(True), "rare": F.array().cast("array<string>"), "word": F.lit(NO_WORD)}
        keys, kept = names.withColumns(extra), postings.withColumns(extra)
    key = ["prefix", "word", "wide"]
    kept = kept.join(keys.select(*key).distinct(), key, "left_semi")
    chunks = kept.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    near = (
        kept.join(chunks, key)
        .groupBy(*key, F.pmod(F.xxhash64("low"), F.col("chunks")).alias("chunk"))
        .agg(F.collect_list(F.struct("low", "words", "rare", "items")).alias("items"))
    )
    met = keys.join(near.select(*key, "items"), key).select("name", _best_of_chunk(similarity, by_word).alias("best"))
    return unfold(met, "best", ["name"]).select("name", "item.code", "item.raw_name", "item.score")


def _near_hits(
    names: DataFrame, postings: DataFrame, similarity: Similarity, lowest_codes: int = C.TOP_HITS
) -> DataFrame:
    """``name, code, raw_name, score``: all of the best, some more, and some twice."""
    if similarity is not word_overlap:
        return _chunk_hits(names, postings, similarity)
    hits = _set_hits(names, postings, lowest_codes)
    longest = [df.agg(F.max(F.size("words"))).first()[0] or 0 for df in (names, postings)]
    if max(longest) <= WIDE:
        return hits
    # without long records only long names have more to ask
    asking = names if longest[1] > WIDE else names.filter(F.size("words") > WIDE)
    return hits.unionByName(_chunk_hits(asking, postings, similarity))


def _ranked(names: DataFrame, postings: DataFrame, similarity: Similarity) -> DataFrame:
    """``name, place`` and the hit: the best five codes of each name."""
    exact = _exact_hits(names, postings).select(
        "name", "code", "raw_name", F.lit(1.0).alias("similarity"),
        F.lit(C.REASON_EXACT).alias("reason"), F.lit(0).alias("src"),
    )
    percent = (F.col("score") * 100).cast("int").cast("string")
    near = _near_hits(names, postings, similarity).select(
        "name", "code", "raw_name", rounded(F.col("score")).alias("similarity"),
        F.concat(F.lit(C.REASON_OVERLAP), percent, F.lit("%")).alias("reason"), F.lit(1).alias("src"),
    )
    # a code that several records share counts once, with its best hit
    hit = F.struct((-F.col("similarity")).alias("rank"), "src", "raw_name", "reason")
    once = exact.unionByName(near).groupBy("name", "code").agg(F.min(hit).alias("hit"))
    order = Window.partitionBy("name").orderBy("hit.rank", "hit.src", "code")
    return (
        once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= C.TOP_HITS)
        .select(
            "name", "place", F.col("code").alias("material_code"), F.col("hit.raw_name").alias("material_name"),
            (-F.col("hit.rank")).alias("similarity"), "hit.reason",
        )
    )


class GoldenIndex:
    """Filed names of a golden version in files, kept up to date by increments.

    A generation holds the postings of changed names, in folders by a hash of the prefix, so a
    batch reads the folders of its own prefixes. A name that changes or goes leaves a tombstone
    for all generations before. When the increments have grown to a share MERGE of the base, a
    new base is written.
    """

    MERGE = 0.25
    #: folders of one generation
    FOLDERS = 64

    def __init__(self, golden: DataFrame):
        self.spark = golden.sparkSession
        self.names = materialize(active_names(golden))
        self._base(self.names)

    def _base(self, names: DataFrame) -> None:
        self.generations = [self._write(names)]
        #: per generation after the base: the names it replaces or takes out
        self.gone: list[DataFrame] = []
        self.base_rows, self.delta_rows = names.count(), 0

    def _write(self, names: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "postings")
        folder = F.pmod(F.xxhash64("prefix"), F.lit(self.FOLDERS)).cast("int")
        filed(names).withColumn("folder", folder).repartitionByRange("folder", "prefix", "low").write.partitionBy("folder").parquet(path)
        schema = f"prefix string, low string, words array<string>, {ITEMS}, folder int"
        return self.spark.read.schema(schema).parquet(path)

    def refresh(self, golden: DataFrame) -> int:
        """Brings the index to a new version; returns how many names were filed anew or taken out."""
        new = materialize(active_names(golden))
        old = self.names.select("low", F.col("items").alias("old_items"))
        changed = materialize(
            new.join(old, "low", "full_outer").filter(~F.col("items").eqNullSafe(F.col("old_items"))).select("low", "words", "items")
        )
        count = changed.count()
        self.names = new
        if count == 0:
            return 0
        self.delta_rows += count
        if self.delta_rows > self.MERGE * max(self.base_rows, 1):
            self._base(new)
        else:
            self.generations.append(self._write(changed.filter("items is not null")))
            self.gone.append(changed.select("low"))
        return count

    def postings_for(self, names: DataFrame) -> DataFrame:
        """``prefix, low, words, items`` of the records that ``names`` can ask for."""
        asked = names.select("prefix").distinct().withColumn(
            "folder", F.pmod(F.xxhash64("prefix"), F.lit(self.FOLDERS)).cast("int")
        )
        folders = [r.folder for r in asked.select("folder").distinct().collect()]  # FOLDERS at most
        out = None
        for at, postings in enumerate(self.generations):
            own = postings.filter(F.col("folder").isin(folders)).join(asked, ["prefix", "folder"], "left_semi").drop("folder")
            for gone in self.gone[at:]:
                own = own.join(gone, "low", "left_anti")
            out = own if out is None else out.unionByName(own)
        return materialize(out)


def build_index(golden: DataFrame) -> GoldenIndex:
    return GoldenIndex(golden)


def check_duplicates(
    candidates: DataFrame,
    golden: DataFrame | None = None,
    similarity: Similarity = word_overlap,
    index: GoldenIndex | None = None,
) -> DataFrame:
    """Add ``dedup_result`` and ``is_duplicate`` to every candidate.

    Pass ``golden``, or an ``index`` kept in files when many small batches are checked.
    ``similarity`` scores two word arrays; scores below 0.5 are dropped. Another one than
    the word overlap is tried on all records that contain the prefix, since nothing is
    known of the words that a good pair shares.
    """
    kept = [c for c in candidates.columns if c not in ("dedup_result", "is_duplicate")]
    names = materialize(candidate_names(candidates))
    postings = index.postings_for(names) if index else postings_for(names, golden)
    hit = F.struct("material_code", "material_name", "similarity", "reason")
    results = _ranked(names, postings, similarity).groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("place", hit.alias("hit")))).alias("_best")
    )
    best = F.col("_best.hit")
    empty = F.array().cast("array<struct<material_code:string,material_name:string,similarity:double,reason:string>>")
    best = F.coalesce(best, empty)
    flagged = F.exists(F.slice(best, 1, C.FLAG_HITS), lambda h: h.similarity >= C.FLAG_SCORE)
    confidence = F.coalesce(F.get(best, F.lit(0)).similarity, F.lit(0.0))
    return (
        candidates.select(*kept, normalise(F.col("material_name")).alias("name"))
        .join(results, "name", "left")
        .select(
            *kept,
            F.struct(
                flagged.alias("is_duplicate"), confidence.alias("confidence"),
                best.alias("similar_materials"),
            ).alias("dedup_result"),
            flagged.alias("is_duplicate"),
        )
    )


def similar_rows(checked: DataFrame, key: str = "id") -> DataFrame:
    """One row per reported similar material, ranked from 1."""
    hits = checked.select(key, F.col("dedup_result.similar_materials").alias("hits"))
    return unfold(hits, "hits", [key]).select(
        key, (F.col("position") + 1).alias("rank"), "item.*"
    )


def exact_rows(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per candidate and exact hit, the five lowest codes of each name."""
    names = materialize(candidate_names(candidates))
    named = candidates.select("id", normalise(F.col("material_name")).alias("name"))
    found = _exact_hits(names, postings_for(names, golden))
    return named.join(found, "name").select("id", F.col("code").alias("material_code"))


def containment_rows(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per candidate and containment hit, its five best, with the unrounded score."""
    names = materialize(candidate_names(candidates))
    near = _near_hits(names, postings_for(names, golden), word_overlap, 2 * C.TOP_HITS)
    once = near.groupBy("name", "code").agg(F.max("score").alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "code")
    best = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= C.TOP_HITS)
    named = candidates.select("id", normalise(F.col("material_name")).alias("name"))
    return named.join(best, "name").select("id", F.col("code").alias("material_code"), "score")
