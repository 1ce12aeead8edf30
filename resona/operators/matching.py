"""Record linkage: blocking, scored pairs, leader groups, top matches and search.

Pairs come from equi-joins over DISTINCT names, on keys that a match must share, so
copies of a name never multiply and none is lost. Scores run on the surviving pairs only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions.fuzzy import all_scores, edit_ratio, likely_match, partial_ratio, ratio, token_sort_ratio, weighted
from resona.functions.numeric import cut_bins
from resona.operators.catalog import merge_duplicates
from resona.operators.scores import PLATFORMS, QUALITY_FEATURES
from resona.operators.tables import settled, top_per_group


def _growth(least: float, metric: str) -> float:
    """How many pairs of characters more a match must share with each character of its lengths."""
    grow = 3 * least / 200 - 1 if metric != "edit" else 2 * least / 100 - 1
    if grow < 0:
        raise ValueError(f"a match at {least} by {metric} may share no pair of characters")
    return grow


def _named(df: DataFrame, column: str, metric: str) -> DataFrame:
    """(name, size, pairs) of the distinct names: the numbered, padded pairs of characters of the text that is compared."""
    names = df.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    text = F.array_join(F.array_sort(F.filter(F.split("name", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")), " ") if metric == "token_sort" else F.col("name")
    padded, size = F.concat(F.lit("\x01"), F.col("text"), F.lit("\x02")), F.char_length("text")
    cut = F.transform(F.sequence(F.lit(1), size + 1), lambda i: padded.substr(i, F.lit(2)))
    numbered = F.transform("cut", lambda g, i: F.concat(g, F.size(F.filter(F.slice("cut", 1, i + 1), lambda x: x == g)).cast("string")))
    return names.withColumn("text", text).withColumn("cut", cut).select("name", size.alias("size"), numbered.alias("pairs"))


def _prefixes(names: DataFrame, rarity: DataFrame, least: float, metric: str) -> DataFrame:
    """(name, size, at, pair): the rarest pairs of each name, as many as any match of its must share one of, and their places in the order of rarity."""
    grow = _growth(least, metric)
    grow = grow * 200 / (200 - least) if metric != "edit" else grow
    ranked = names.select("name", "size", F.explode("pairs").alias("pair")).join(rarity, "pair").groupBy("name", "size").agg(F.array_sort(F.collect_list(F.struct("often", "pair"))).alias("ranked"))
    many = (F.col("size") + 2 - F.ceil(1 + F.col("size") * grow - 1e-9)).cast("int")
    return ranked.select("name", "size", F.posexplode(F.slice("ranked", 1, many)).alias("at", "own")).select("name", "size", "at", F.col("own.pair").alias("pair"))


def near_pairs(left: DataFrame, right: DataFrame, column: str, least: float, metric: str = "ratio") -> DataFrame:
    """(a, b): every pair of distinct names whose similarity can reach ``least``; none that does is left out. metric as in ``scored_pairs``.

    A match shares at least 1 + (len(a) + len(b)) * (3 * least / 200 - 1) pairs of characters by ratio (a character
    missing on one side spoils two pairs of the one name and one of the other), and 1 + longest * (2 * least / 100 - 1) by edit distance.
    Pairs are ordered by how many names hold them, rarest first, and names meet in those of their rarest pairs that a match can't do without. Where
    they meet first, the pairs behind must suffice (positions); what is left must share as many pairs as a match (count).
    """
    sides = [settled(_named(df, column, metric)) for df in ((left,) if left is right else (left, right))]
    rarity = settled(reduce(DataFrame.union, [s.select(F.explode("pairs").alias("pair")) for s in sides]).groupBy("pair").agg(F.count("*").alias("often")))

    def side(names: DataFrame, to: str) -> DataFrame:
        return _prefixes(names, rarity, least, metric).select("pair", F.col("name").alias(to), F.col("size").alias(f"_{to}"), F.col("at").alias(f"at_{to}"))

    shorter, longer = F.least("_a", "_b"), F.greatest("_a", "_b")
    fits = shorter * 100 >= longer * least if metric == "edit" else shorter * 200 >= (shorter + longer) * least
    needed = F.ceil(1 + (longer if metric == "edit" else shorter + longer) * _growth(least, metric) - 1e-9)
    behind = F.least(F.col("_a") + 1 - F.col("at_a"), F.col("_b") + 1 - F.col("at_b"))
    met = side(sides[0], "a").join(side(sides[-1], "b"), "pair").where(fits & (behind >= needed)).select("a", "b", "_a", "_b").distinct()
    full = lambda names, to: names.select(F.col("name").alias(to), F.col("pairs").alias(f"pairs_{to}"))
    counted = met.join(full(sides[0], "a"), "a").join(full(sides[-1], "b"), "b")
    return counted.where(F.size(F.array_intersect("pairs_a", "pairs_b")) >= needed).select("a", "b")


def scored_pairs(pairs: DataFrame, least: float, metric: str = "ratio") -> DataFrame:
    """Pairs whose similarity reaches ``least``; metric: ratio, token_sort or edit (JVM-side)."""
    score = {"ratio": ratio, "token_sort": token_sort_ratio, "edit": edit_ratio}[metric](F.col("a"), F.col("b"))
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def _leads_in_one_task(known: DataFrame) -> DataFrame:
    """(node, leads) of the open names by their order, from known (node, on, neg, leads: of ``on``, null while open). Its size has been checked."""
    import pandas as pd

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, bool] = {}
        for node, own in group.sort_values("node").groupby("node", sort=True):
            found[node] = all((found[on] if state is None else bool(state)) != neg for on, neg, state in zip(own["on"], own["neg"], own["leads"], strict=True))
        return pd.DataFrame({"node": list(found), "leads": list(found.values())})

    return known.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(decide, "node string, leads boolean")


def leaders(names: DataFrame, edges: DataFrame, few: int = 500_000) -> DataFrame:
    """(node, leads) for every name of ``names`` (node): a name leads unless an earlier neighbour in ``edges`` (b before a) does.

    A name that waits for just one other takes that one's state or its opposite, so stretches of
    such names are pointer chains: they are contracted by doubling, in about log2(longest) joins, and the
    names that wait for several then wait for the heads of the chains alone. What two opposite
    states of one head demand can't be, and is decided at once. Each turn decides
    the first name left at least, so every graph settles. Up to ``few`` open edges are decided in one task.
    """
    deps = settled(edges.select(F.col("a").alias("node"), F.col("b").alias("on"), F.lit(True).alias("neg")).distinct())
    decided = settled(names.join(deps.select("node").distinct(), "node", "left_anti").select("node", F.lit(True).alias("leads")))
    chains = []  # names that follow one head, oldest first
    while not deps.isEmpty():
        if deps.count() <= few:
            known = deps.join(decided.withColumnRenamed("node", "on"), "on", "left").select("node", "on", "neg", "leads")
            decided = settled(decided.unionByName(_leads_in_one_task(known)))
            break
        single = deps.groupBy("node").agg(F.count("*").alias("n"), F.first("on").alias("on"), F.first("neg").alias("neg")).where("n = 1").drop("n")
        single = settled(single)
        while True:  # pointers double
            ahead = single.select(F.col("node").alias("on"), F.col("on").alias("on2"), F.col("neg").alias("neg2"))
            met = settled(single.join(ahead, "on", "left").select("node", F.coalesce("on2", "on").alias("on"), (F.col("neg") != F.coalesce("neg2", F.lit(False))).alias("neg"), F.col("on2").isNotNull().alias("moved")))
            single = met.drop("moved")
            if met.where("moved").isEmpty():
                break
        chains.append(single)
        heads = single.select(F.col("node").alias("on"), F.col("on").alias("on2"), F.col("neg").alias("neg2"))
        many = deps.join(single.select("node"), "node", "left_anti").join(heads, "on", "left")
        many = many.select("node", F.coalesce("on2", "on").alias("on"), (F.col("neg") != F.coalesce("neg2", F.lit(False))).alias("neg")).distinct()
        known = settled(many.join(decided.withColumnRenamed("node", "on"), "on", "left"))
        opposed = known.groupBy("node", "on").agg(F.count("*").alias("n")).where("n = 2").select("node")
        never = known.where(F.col("leads") == F.col("neg")).select("node").union(opposed).distinct()
        live = known.join(never, "node", "left_anti")
        waiting = live.where("leads IS NULL").select("node", "on", "neg")
        free = live.select("node").distinct().join(waiting.select("node").distinct(), "node", "left_anti")
        decided = settled(decided.unionByName(never.select("node", F.lit(False).alias("leads"))).unionByName(free.select("node", F.lit(True).alias("leads"))))
        deps = settled(waiting)
    for single in reversed(chains):
        heads = decided.select(F.col("node").alias("on"), "leads")
        decided = settled(decided.unionByName(single.join(heads, "on").select("node", (F.col("leads") != F.col("neg")).alias("leads"))))
    return decided


def leader_groups(names: DataFrame, column: str, edges: DataFrame, few: int = 500_000) -> DataFrame:
    """(name, leader): names in order; a name that no earlier leader took leads, and takes its unclaimed neighbours.

    This is the greedy order, not transitive closure; any graph settles (see ``leaders``).
    """
    nodes = settled(names.select(F.col(column).alias("node")).where("node IS NOT NULL").distinct())
    before = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = leaders(nodes, before, few)
    first = found.where("leads").select("node")
    # whoever does not lead has an earlier neighbour that does
    taken = before.join(first.withColumnRenamed("node", "b"), "b", "left_semi").join(first.withColumnRenamed("node", "a"), "a", "left_anti").groupBy(F.col("a").alias("name")).agg(F.min("b").alias("leader"))
    return first.select(F.col("node").alias("name"), F.col("node").alias("leader")).unionByName(taken)


def resolve(df: DataFrame, key: str, least: float = 85) -> DataFrame:
    """``df`` with each row's key replaced by the leader of its group of similar keys; null keys stay."""
    names = df.select(key).where(F.col(key).isNotNull()).distinct()
    edges = scored_pairs(near_pairs(names, names, key, least).where("a < b"), least)
    groups = leader_groups(names, key, edges).select(F.col("name").alias("_name"), "leader")
    return df.join(groups, df[key] == F.col("_name"), "left").withColumn(key, F.coalesce("leader", key)).drop("_name", "leader")


def merge_similar(df: DataFrame, key: str, features: Sequence[str], least: float = 95) -> DataFrame:
    """Rows whose keys fall to one leader at ``least`` merged into one; the leader names the merged row. Rows without a key stay apart from them, as one.

    Keys are often cleaned names, which cost more than the merge does, and the merge reads its rows several times: the columns it needs are written once.
    """
    needed = {key, *features, *QUALITY_FEATURES, *PLATFORMS, "rec_id", "source_dataset", "genre", "normalized_popularity", "source_count"}
    return merge_duplicates(resolve(settled(df.select(*[c for c in df.columns if c in needed])), key, least), [key], features)


CONFIDENCE = ([0, 70, 85, 95, 100], ["low", "medium", "high", "exact"])


def best_matches(left: DataFrame, right: DataFrame, column: str, n: int = 3, least: float = 70) -> DataFrame:
    """Per left name its ``n`` best right names by sorted tokens, with rank and confidence."""
    scored = scored_pairs(near_pairs(left, right, column, least, "token_sort"), least, "token_sort")
    return top_per_group(scored, ["a"], [F.desc("score"), F.col("b")], n).withColumn("confidence", cut_bins(F.col("score"), *CONFIDENCE, include_lowest=True))


def mutual_best(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's first match."""
    there = backward.where("rank = 1").select(F.col("a").alias("b"), F.col("b").alias("a"))
    return forward.where("rank = 1").select("a", "b", "score").join(there, ["a", "b"])


def match_report(matches: DataFrame) -> DataFrame:
    """Totals, distinct sides, mean and median score per confidence."""
    return matches.groupBy("confidence").agg(
        F.count("*").alias("matches"), F.countDistinct("a").alias("left_names"), F.countDistinct("b").alias("right_names"), F.avg("score").alias("mean"), F.median("score").alias("middle"))


def likely_pairs(songs: DataFrame, least: float = 70, threshold: float = 85) -> DataFrame:
    """Every two songs (artist, track) whose sorted-token ratios both reach ``least``: both scores, the tracks' weighted score, and whether they are the same song by each predicate.

    Artists and tracks are paired apart, over distinct names and without loss, and meet by two joins.
    """
    near = lambda c: near_pairs(songs, songs, c, least, "token_sort").withColumn("score", token_sort_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    side = lambda to: songs.select(F.col("artist").alias(f"artist_{to}"), F.col("track").alias(f"track_{to}"))
    artists = near("artist").select(F.col("a").alias("artist_a"), F.col("b").alias("artist_b"), F.col("score").alias("artist_score"))
    tracks = near("track").withColumn("all", all_scores(F.col("a"), F.col("b"))).select(F.col("a").alias("track_a"), F.col("b").alias("track_b"), F.col("score").alias("track_score"), weighted(F.col("all")).alias("weighted"))
    met = side("a").join(tracks, "track_a").join(side("b"), "track_b").join(artists, ["artist_a", "artist_b"]).where("(artist_a, track_a) < (artist_b, track_b)")
    both = F.col("artist_score"), F.col("track_score")
    return met.withColumns({"strict": likely_match(*both, threshold), "lenient": likely_match(*both, threshold, strict=False)})


def _outlines(catalog: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """``catalog`` with _<c>: the lower-case name in which every character that no query holds is one and the same other character."""
    each = F.transform(F.sequence(F.lit(1), F.char_length("q")), lambda i: F.col("q").substr(i, F.lit(1)))
    held = {r["c"] for r in asked.select(F.explode(each).alias("c")).distinct().collect() if r["c"]}  # characters, not rows
    other = next(chr(c) for c in range(1, 1 << 16) if chr(c) not in held)
    pattern = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(held)) + "]" if held else r"[\s\S]"
    return catalog.withColumns({f"_{c}": F.regexp_replace(F.lower(c), pattern, other) for c in columns})


def search(catalog: DataFrame, queries: DataFrame, columns: list[str], rank_by: str, least: float = 60, limit: int = 10, block: int = 256) -> DataFrame:
    """Per query (column q) the catalog rows whose best partial ratio over ``columns`` exceeds ``least``.

    A character that no query holds matches nothing, whichever it is, so names that differ by such characters alone
    score alike: they fall to one outline, and of the rows with the same outlines only the first ``limit`` can be found.
    The queries meet the distinct outlines, in blocks of ``block`` queries: a partial ratio
    this low allows no key that both must share. Before anything is scored, the characters that both hold (each as often as
    both do) must suffice: a common subsequence above ``least`` has more than least / (200 - least) of the
    shorter text's.
    """

    def characters(text: Column) -> Column:
        """The text's characters, numbered among equals."""
        return F.transform(F.array(F.split(text, "")), lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(cs, 1, i + 1), lambda x: x == c)).cast("string"))))[0]

    asked = settled(queries.select("q").where("q IS NOT NULL").distinct())
    outlined = [f"_{c}" for c in columns]
    rows = _outlines(catalog.select(*columns, rank_by).distinct(), asked, columns)
    order = [F.desc_nulls_last(rank_by), *[F.col(c) for c in columns]]
    rows = settled(top_per_group(rows, outlined, order, limit, "_place").drop("_place"))
    names = rows.select(F.explode(F.array(*outlined)).alias("name")).where("name IS NOT NULL").distinct().withColumn("cs", characters(F.col("name")))
    blocks = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(max(1, -(-asked.count() // block))))).agg(F.collect_list(F.struct("q", characters(F.col("q")).alias("q_cs"))).alias("qs"))
    met = settled(names).crossJoin(settled(blocks.select("qs"))).select("name", "cs", F.inline("qs"))
    shared, shorter = F.size(F.array_intersect("cs", "q_cs")), F.least(F.char_length("name"), F.char_length("q"))
    pairs = met.where(shared * (200 - least) > least * shorter).select("name", "q")
    hits = settled(pairs.withColumn("score", partial_ratio(F.col("q"), F.col("name"))).where(F.col("score") > least))
    found = [rows.join(hits, rows[c] == hits["name"]).drop("name") for c in outlined]
    best = reduce(DataFrame.unionByName, found).groupBy("q", *columns, rank_by).agg(F.max("score").alias("score"))
    return top_per_group(best, ["q"], [F.desc("score"), *order], limit)
