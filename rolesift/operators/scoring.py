"""Weighted keyword relevance of plain, lower-case text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators.joins import many_to_one
from rolesift.rules import RuleSet, keyword_table
from rolesift.session import stage

_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"
Weighted = Sequence[tuple[str, float]]


def word_pattern(keyword: str) -> str:
    """`keyword` between two word boundaries, whatever the Java version's own `\\b`.

    The literal comes first, so that the engine skips to its occurrences, and the
    boundary before it is looked up from its end.
    """
    before = "(?<!" if re.match(r"\w", keyword) else "(?<="
    after = "(?!" if re.search(r"\w$", keyword) else "(?="
    literal = rf"\Q{keyword}\E"
    return f"{literal}{after}{_WORD}){before}{_WORD}{literal})"


def match_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords found as whole words, in list order, each once; matches may overlap.

    A plain substring search comes first; most keywords fail it.
    """
    found = [
        F.when(text.contains(k) & text.rlike(word_pattern(k)), F.lit(k)) for k in keywords
    ]
    return _list(found)


def _list(items: list[Column]) -> Column:
    """The non-null items; an array function without a lambda, so it is compiled."""
    if not items:
        return F.array().cast("array<string>")
    kept = F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))
    return F.coalesce(kept, F.array().cast("array<string>"))


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """The first match of each pattern, or null, in list order."""
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in patterns]
    return F.array(*found).cast("array<string>")


def match_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """The first match of every pattern that matches, in list order."""
    return F.array_compact(pattern_hits(text, patterns))


def pattern_bonus(hits: Column, patterns: Weighted) -> Column:
    """The sum of the bonuses of the patterns that have a hit."""
    total = F.lit(0.0)
    for i, (_, bonus) in enumerate(patterns):
        total = total + F.when(F.get(hits, F.lit(i)).isNotNull(), float(bonus)).otherwise(0.0)
    return total


def effective_weights(keywords: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Keywords with the learned multiplier, 1.0 where none was learned."""
    if overrides is None:
        return keywords.withColumn("multiplier", F.lit(1.0))
    # Through text, so that a 32-bit 1.3 reads as 1.3 and not as 1.2999999523
    learned = overrides.select(
        "keyword", F.col("multiplier").cast("string").cast("double").alias("multiplier")
    )
    joined = keywords.join(learned, "keyword", "left")
    return joined.withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def _multiplier_map(df: DataFrame, rules: RuleSet, overrides: DataFrame) -> Column:
    """keyword → multiplier as one scalar value, limited to the rule list's keywords."""
    listed = [k for k, _ in (*rules.positive, *rules.negative)]
    table = effective_weights(
        keyword_table(df.sparkSession, rules).select("keyword").distinct(),
        overrides.filter(F.col("keyword").isin(listed)),
    )
    pairs = F.collect_list(F.struct("keyword", "multiplier"))
    return table.agg(F.map_from_entries(pairs)).scalar()


def _weight_map(weights: Weighted) -> Column:
    if not weights:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*[x for k, w in weights for x in (F.lit(k), F.lit(float(w)))])


def relevance(
    df: DataFrame,
    text_col: str,
    rules: RuleSet,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Add `score` and the three match lists for the plain text in `text_col`.

    The score is the positive weights less the negative ones, each times its
    multiplier, plus pattern bonuses, kept within 0 and 100. Sums run in list
    order, so they do not depend on the plan. Empty text scores 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.struct(
        match_keywords(text, [k for k, _ in rules.positive]).alias("positive_matches"),
        match_keywords(text, [k for k, _ in rules.negative]).alias("negative_matches"),
        pattern_hits(text, [p for p, _ in rules.patterns]).alias("_hits"),
    )
    # As a one-row generator, so that a later filter on the score is not pushed below
    # it, where every match would be computed again
    out = df.select(*df.columns, F.inline(F.array(found)))
    out = out.withColumn("experience_matches", F.array_compact("_hits"))
    if overrides is not None:
        out = out.withColumn("_learned", _multiplier_map(df, rules, overrides))

    def weighted(matches: str, weights: Weighted) -> Column:
        table = _weight_map(weights)

        def add(total: Column, keyword: Column) -> Column:
            worth = F.element_at(table, keyword)
            if overrides is not None:
                worth = worth * F.element_at(F.col("_learned"), keyword)
            return total + worth

        return F.aggregate(matches, F.lit(0.0), add) if weights else F.lit(0.0)

    raw = (
        weighted("positive_matches", rules.positive)
        - weighted("negative_matches", rules.negative)
        + pattern_bonus(F.col("_hits"), rules.patterns)
    )
    scored = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    return scored.drop("_hits", "_learned")


def score_filter(df: DataFrame, threshold: float) -> DataFrame:
    """Rows at or above the threshold, on the unrounded score."""
    return df.filter(F.col("score") >= threshold)


def stored_score(score: Column) -> Column:
    """The score as an INT column keeps it."""
    return F.round(score).cast("int")


def match_keyword_table(
    df: DataFrame, id_col: str, text_col: str, keywords: DataFrame, max_words: int
) -> DataFrame:
    """Long form (id, keyword) for keyword lists too large to spell out in a plan.

    Each text is cut into runs of 1 to `max_words` words with what stands between
    them, and the runs are joined by equality to the `keyword` table. For keywords
    that begin and end with a word character this is the same as a whole-word
    search. Keywords of over `max_words` words are searched for by no run.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = df.select(
        id_col,
        F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), 1).alias("words"),
        F.regexp_extract_all(text, F.lit(f"({_WORD}+{_NOT_WORD}*)"), 1).alias("pieces"),
    )

    def runs(n: int) -> Column:
        def run(word: Column, i: Column) -> Column:
            head = F.array_join(F.slice("pieces", i + 1, F.lit(n - 1)), "")
            return F.concat(head, F.get(F.col("words"), i + (n - 1)))

        return F.array_compact(F.transform("words", run))

    spans = F.concat(F.col("words"), *[runs(n) for n in range(2, max_words + 1)])
    # Outer, as a plain explode adds a size filter that would cut every text twice
    exploded = cut.select(id_col, F.explode_outer(F.array_distinct(spans)).alias("keyword"))
    return many_to_one(exploded, keywords.select("keyword").distinct(), ["keyword"]).select(
        id_col, "keyword"
    )


def _cut(text: Column) -> Column:
    """`words` of a text and `pieces`, each word with what follows it up to the next one."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), 1).alias("words"),
        F.regexp_extract_all(text, F.lit(f"({_WORD}+{_NOT_WORD}*)"), 1).alias("pieces"),
    )


def _gap(at: Column) -> Column:
    """What stands between word `at` and the next one."""
    return F.substring(F.get("pieces", at), F.length(F.get("words", at)) + 1, F.lit(2**31 - 1))


def _anchors(places: DataFrame, keywords: DataFrame) -> DataFrame:
    """word -> shapes: for each word that is some keyword's rarest, where keywords continue around it.

    A shape says how many of the keyword's words stand before the anchor (`before`) and in all
    (`n_words`), and whether marks open or close it. There are fewer shapes of a word than
    squares of the longest keyword's words, however many keywords share it.
    """
    cut = keywords.select("keyword", F.inline(F.array(_cut(F.col("keyword")))))
    each = stage(cut.select("keyword", F.posexplode("words").alias("before", "word"), F.size("words").alias("n_words")), "keyword-words")
    seen = many_to_one(places, each.select("word").distinct(), ["word"])
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A keyword with a word that no text holds is found nowhere
    common = each.join(stage(counts, "word-counts"), "word", "left")
    rarest = common.groupBy("keyword", "n_words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "before", "word")).alias("a")
    ).filter("a.n > 0")
    shape = F.struct(
        F.col("a.before").alias("before"), "n_words",
        F.col("keyword").rlike(f"^{_NOT_WORD}").alias("opened"),
        F.col("keyword").rlike(f"{_NOT_WORD}\\z").alias("closed"),
    )
    return rarest.groupBy(F.col("a.word").alias("word")).agg(F.collect_set(shape).alias("shapes"))


def match_keyword_phrases(df: DataFrame, id_col: str, text_col: str, keywords: DataFrame) -> DataFrame:
    """Distinct (id, keyword) for a `keyword` table of any size and keywords of any length.

    The same as a whole-word search by `word_pattern`, also for keywords that begin or end
    with marks, such as `c++` or `.net`: there the boundary asks for a word beyond the marks.
    Every word of a keyword is a whole word of the text, so each keyword is looked for only
    around its word that is rarest in the texts: these anchors are joined to the texts'
    words, the run of words and marks that each shape of the anchor asks for is cut out around the
    place, and runs are joined to the keywords by equality. A keyword without any word is
    all that stands between two words.

    Texts are not shuffled, only runs around anchors. Null texts hold nothing; null
    and empty keywords are found nowhere; repeated keywords and rows of one id count once.
    """
    known = stage(keywords.select("keyword").filter("keyword <> ''").distinct(), "keywords")
    texts = df.select(F.col(id_col).alias("id"), F.inline(F.array(_cut(F.coalesce(F.col(text_col), F.lit(""))))))
    # Outer, as a plain explode adds a size filter that would cut every text twice
    places = texts.select(F.explode_outer("words").alias("word"))
    anchors = stage(_anchors(places, known), "anchors")
    reach = anchors.select(F.max(F.array_max("shapes.n_words"))).first()[0] or 1
    with_word = known.filter(F.col("keyword").rlike(_WORD))

    # Texts in blocks of some words, with the words around them, so that no row of a word
    # carries a whole text
    block = 4 * reach + 16

    def part(first: Column) -> Column:
        low = F.greatest(first - reach, F.lit(0))
        near = [F.slice(name, low + 1, first - low + block + reach).alias(name) for name in ("words", "pieces")]
        return F.struct(
            *near, F.slice("words", first + 1, F.lit(block)).alias("own"), (first - low).alias("skip"),
            (F.size("words") - low).alias("left"),
        )

    firsts = F.sequence(F.lit(0), F.size("words"), F.lit(block))
    blocks = texts.select("id", F.inline(F.transform(firsts, part)))
    placed = blocks.select("id", "words", "pieces", "skip", "left", F.posexplode_outer("own").alias("at", "word"))
    placed = many_to_one(placed, anchors, ["word"]).withColumn("at", F.col("at") + F.col("skip"))
    hits = placed.select("id", "at", "left", "words", "pieces", F.inline("shapes"))
    start, n = F.col("at") - F.col("before"), F.col("n_words")
    end = start + n - 1
    whole = (start >= F.when(F.col("opened"), 1).otherwise(0)) & (
        end < F.col("left") - F.when(F.col("closed"), 1).otherwise(0)
    )
    run = F.concat(
        F.when(F.col("opened"), _gap(start - 1)).otherwise(""),
        F.array_join(F.slice("pieces", start + 1, n - 1), ""),
        F.when(F.col("closed"), F.get("pieces", end)).otherwise(F.get("words", end)),
    )
    runs = hits.filter(whole).select("id", run.alias("keyword"))
    found = many_to_one(runs, with_word, ["keyword"])

    bare = known.filter(~F.col("keyword").rlike(_WORD))
    if not bare.isEmpty():
        inner = F.transform(F.slice("pieces", F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0))),
                            lambda p: F.regexp_extract(p, f"(?s)^{_WORD}+(.*)", 1))
        gaps = texts.select("id", F.explode_outer(F.array_distinct(inner)).alias("keyword"))
        found = found.unionByName(many_to_one(gaps, bare, ["keyword"]))
    return found.select(F.col("id").alias(id_col), "keyword").distinct()
