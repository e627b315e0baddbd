"""Which artifact an arriving name belongs to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import paths
from .durable import durable, fetch

GRAM = 8


def _grams(text: Column, size: Column) -> Column:
    """Hashes of all substrings of ``size`` characters; of a shorter text, of the whole."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, size)))


def candidates(texts: DataFrame, text: str, pieces: DataFrame, needle: str, piece: str) -> DataFrame:
    """(_id, needle): texts that hold a gram every text with the needle holds; none is missed, some are in vain.

    ``texts``: _id, text. ``pieces``: needle, piece; a text with the needle holds all its pieces. A gram is a piece
    of up to ``GRAM`` characters itself, else any part of that length, and travels as a hash. Each needle
    meets texts on the gram that fewest needles offer: a gram that c needles chose makes at most c pairs per
    text, so pairs grow with the texts and not with texts times needles. Neither side is broadcast unless it was
    counted: what an explode makes is far larger than Spark's estimate of it.
    """
    size = F.least(F.length(piece), F.lit(GRAM))
    offers = durable(pieces.where(F.col(piece) != "").select(needle, size.alias("_size"), F.explode(_grams(F.col(piece), size)).alias("_gram")).distinct())
    wanted = offers.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", (-F.col("_size")).alias("_s"), "_gram")).alias("_r")
    chosen = durable(offers.join(wanted.hint("merge"), "_gram").groupBy(needle).agg(rarest).select(needle, (-F.col("_r._s")).alias("_size"), "_r._gram"))
    sizes = sorted(r[0] for r in chosen.select("_size").distinct().collect()) or [GRAM]
    held = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), F.lit(n)) for n in sizes])))
    return fetch(texts.select("_id", F.explode(held).alias("_gram")), chosen.select(needle, "_gram"), ["_gram"]).select("_id", needle).distinct()


def contains_join(haystacks: DataFrame, needles: DataFrame, haystack: str, needle: str) -> DataFrame:
    """Pairs where the haystack contains the needle, both already lower-cased.

    Not a nested loop: distinct texts meet on one gram of a needle (``candidates``), and only
    those pairs are tested. Every containing pair is found exactly once.
    """
    texts = haystacks.select(haystack).where(F.col(haystack).isNotNull()).distinct().withColumn("_id", F.xxhash64(haystack))
    met = candidates(texts, haystack, needles.select(needle, F.col(needle).alias("_piece")).distinct(), needle, "_piece")
    hits = texts.join(met.hint("merge"), "_id").where(F.contains(F.col(haystack), F.col(needle))).select(haystack, needle)
    return haystacks.join(hits.hint("merge"), haystack).join(needles.hint("merge"), needle)


PIECE = 3
BATCH = 256
# What an escape with a letter or digit takes with it.
TAKEN = re.compile(r"x(\{[^}]*\}|..)|u....|[pPN](\{[^}]*\}|.)|k<[^>]*>|c.|0[0-7]{1,3}|[1-9][0-9]*|.", re.S)


def required_literals(pattern: str) -> list[str]:
    """Runs of ``PIECE`` or more ASCII characters, lower-cased, that every match of a regular expression holds.

    Only plain characters outside groups and classes are sure. A quantifier that allows none takes the character
    before it away, any quantifier ends the run, and an alternative at the top or a comment mode makes nothing sure.
    """
    runs, run, at = [], "", 0

    def skipped(start: int, opens: str, closes: str) -> int:
        """The place behind the bracket that closes the one at ``start``."""
        depth, k = 0, start
        while k < len(pattern):
            if pattern.startswith("\\Q", k):
                end = pattern.find("\\E", k)
                k = len(pattern) if end < 0 else end + 2
                continue
            if pattern[k] == "\\":
                k += 2
                continue
            if opens == "(" and pattern[k] == "[":
                k = skipped(k, "[", "]")
                continue
            depth += (pattern[k] == opens) - (pattern[k] == closes)
            k += 1
            if closes == "]" and k == start + 1:
                k += pattern.startswith("^", k)
                k += pattern.startswith("]", k)
            if not depth:
                break
        return k

    if re.search(r"\(\?[a-zA-Z-]*x", pattern):
        return []
    while at < len(pattern):
        c, step = pattern[at], 1
        if c == "\\" and pattern.startswith("Q", at + 1):
            end = pattern.find("\\E", at)
            end = len(pattern) if end < 0 else end
            run += pattern[at + 2:end]
            at = min(len(pattern), end + 2)
            continue
        if c == "\\":
            taken = TAKEN.match(pattern, at + 1)
            if taken is None:
                return []
            step = 1 + len(taken[0])
            plain = not (taken[0][0].isascii() and taken[0][0].isalnum())
            if plain:
                run += taken[0]
            else:
                runs.append(run)
                run = ""
        elif c == "|":
            return []
        elif c in "([":
            runs.append(run)
            run, step = "", skipped(at, c, {"(": ")", "[": "]"}[c]) - at
        elif c in "?*{":
            runs.append(run[:-1])
            run, step = "", (pattern.find("}", at) - at + 1 or len(pattern)) if c == "{" else 1
        elif c in "+.^$)":
            runs.append(run)
            run = ""
        else:
            run += c
        at += step
    pieces = [p for r in [*runs, run] for p in re.findall(r"[ -~]+", r)]
    return [p.lower() for p in pieces if len(p) >= PIECE]


def required_literal(pattern: str) -> str:
    """The longest of ``required_literals``, '' if there is none."""
    return max(required_literals(pattern), key=len, default="")


@F.pandas_udf(ArrayType(StringType()))
def literal_pieces(pattern: pd.Series) -> pd.Series:
    return pattern.map(required_literals)


def regex_hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_raw, _a) of texts a regular expression of a table is found in; a pattern that does not compile is found nowhere.

    ``texts``: _id, _raw, _low. Patterns with sure literal pieces meet only texts that contain the rarest of them. Those
    without have to be tried on every text: they are packed into rows of up to ``BATCH``, and a text gets the first hit of each row.
    """
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    # Of aliases with one pattern only the first can win.
    first = patterns.where(F.col("pattern").isNotNull()).where(compiles).groupBy("pattern").agg(F.min(F.struct("alias_id", "artifact")).alias("_a"))
    cut = durable(first.withColumn("_pieces", literal_pieces(F.col("pattern"))))
    met = candidates(texts, "_low", cut.select("pattern", F.explode("_pieces").alias("_piece")), "pattern", "_piece")
    near = texts.join(met.hint("merge"), "_id").where(F.expr("_raw rlike pattern")).select("_raw", "pattern")
    found = near.join(cut.select("pattern", "_a").hint("merge"), "pattern").select("_raw", "_a")
    loose = cut.where(F.size("_pieces") == 0)
    batches = -(-loose.count() // BATCH)
    if not batches:
        return found
    packed = loose.groupBy(F.pmod(F.xxhash64("_a.alias_id", "pattern"), F.lit(batches)).alias("_batch")).agg(
        F.sort_array(F.collect_list(F.struct("_a.alias_id", "_a.artifact", "pattern"))).alias("_patterns"))
    tried = texts.select("_raw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("_batch")).join(packed, "_batch")
    best = F.try_element_at(F.filter("_patterns", lambda p: F.rlike(F.col("_raw"), p["pattern"])), F.lit(1))
    hits = tried.select("_raw", best.alias("_p")).where("_p IS NOT NULL").select("_raw", F.struct("_p.alias_id", "_p.artifact").alias("_a"))
    return found.unionByName(hits)


def alias_match(names: DataFrame, aliases: DataFrame, rules: tuple[tuple[int, str, str], ...] = (), key: str = "id", name: str = "name") -> DataFrame:
    """First alias (lowest ``alias_id``) whose pattern is in the name, case ignored.

    ``aliases``: alias_id, artifact, pattern, and optionally is_regex: such a pattern is a
    regular expression, searched in the name as it is written. ``rules`` are more of
    them (alias_id, pattern, artifact): configuration of a fixed, small number, compiled
    into the plan as literals. Equal names are matched once.
    """
    patterns = None
    if "is_regex" in aliases.columns:
        patterns = aliases.where("is_regex").select("alias_id", "artifact", "pattern")
        aliases = aliases.where(~F.coalesce("is_regex", F.lit(False)))
    named = names.select(key, F.col(name).alias("_raw")).where(F.col("_raw").isNotNull())
    texts = named.select("_raw").distinct().select("_raw", F.lower("_raw").alias("_low"), F.xxhash64("_raw").alias("_id"))
    # Of aliases with one pattern only the first can win: one needle per pattern.
    needles = durable(aliases.groupBy(F.lower("pattern").alias("_pattern")).agg(F.min(F.struct("alias_id", "artifact")).alias("_a")))
    met = candidates(texts, "_low", needles.select("_pattern", F.col("_pattern").alias("_piece")), "_pattern", "_piece")
    held = texts.join(met.hint("merge"), "_id").where(F.contains("_low", "_pattern")).select("_raw", "_pattern")
    hits = held.join(needles.hint("merge"), "_pattern").select("_raw", "_a")
    if patterns is not None:
        hits = hits.unionByName(regex_hits(texts, patterns))
    if rules:
        literal = F.array(*[F.when(F.col("_raw").rlike(p), F.struct(F.lit(i).cast("bigint").alias("alias_id"), F.lit(a).alias("artifact"))) for i, p, a in rules])
        by_rule = texts.select("_raw", F.explode(F.filter(literal, lambda r: r.isNotNull())).alias("_a"))
        hits = hits.unionByName(by_rule)
    best = hits.groupBy("_raw").agg(F.min("_a").alias("_a"))
    first = named.join(best.hint("merge"), "_raw").groupBy(key).agg(F.min("_a").alias("_a"))
    return first.select(key, F.col("_a.alias_id").alias("alias_id"), F.col("_a.artifact").alias("artifact"))


def resolve_names(asked: DataFrame, known: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Known artifact for each asked text: equal name, else equal slug, else the only name or slug that contains it.

    ``known``: artifact, slug.
    """
    want = asked.select(key, name, F.lower(name).alias("_low"))
    by_name = known.groupBy(F.lower("artifact").alias("_low")).agg(F.min("artifact").alias("_by_name"))
    by_slug = known.groupBy(F.col("slug").alias(name)).agg(F.min("artifact").alias("_by_slug"))
    direct = want.join(by_name.hint("merge"), "_low", "left").join(by_slug.hint("merge"), name, "left")
    open_asks = durable(direct.where(F.col("_by_name").isNull() & F.col("_by_slug").isNull()).select("_low").distinct())
    texts = known.select("artifact", F.lower("artifact").alias("_text")).unionByName(known.select("artifact", F.lower("slug").alias("_text")))
    found = contains_join(texts.distinct(), open_asks, "_text", "_low").groupBy("_low").agg(
        F.min("artifact").alias("_lo"), F.max("artifact").alias("_hi"))
    only = found.where(F.col("_lo") == F.col("_hi")).select("_low", F.col("_lo").alias("_inside"))
    how = F.when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_slug").isNotNull(), "slug").when(F.col("_inside").isNotNull(), "substring")
    return direct.join(only.hint("merge"), "_low", "left").select(key, name, F.coalesce("_by_name", "_by_slug", "_inside").alias("artifact"), how.alias("how"))


def identify(
    arrivals: DataFrame, known: DataFrame, aliases: DataFrame, rules: tuple[tuple[str, str], ...] = (), key: str = "id",
) -> DataFrame:
    """Name, strategy and confidence of each arrival, by the first step that answers.

    ``arrivals``: key, file_name, override, sidecar (JSON text), top_entry (the only
    top-level entry of the archive, else null). ``known``: artifact, slug. ``rules``
    are (pattern, name with ``$1`` groups), fixed configuration. Each step is a left
    join on a key or a column expression; ``coalesce`` keeps the order.
    """
    stem = paths.stem(F.col("file_name"))
    base = arrivals.withColumn("_stem", stem).withColumn("_clean", paths.clean_name(stem))
    alias = alias_match(base.select(key, F.col("file_name").alias("name")), aliases, key=key).select(key, F.col("artifact").alias("_alias"))
    lookup = known.groupBy(F.lower("artifact").alias("_k")).agg(F.min("artifact").alias("_known"))
    by_clean = lookup.select(F.col("_k").alias("_clean_low"), F.col("_known").alias("_by_clean"))
    by_stem = lookup.select(F.col("_k").alias("_stem_low"), F.col("_known").alias("_by_stem"))
    joined = (
        base.withColumn("_clean_low", F.lower("_clean")).withColumn("_stem_low", F.lower("_stem"))
        .join(alias, key, "left").join(by_clean, "_clean_low", "left").join(by_stem, "_stem_low", "left")
    )
    rule = F.lit(None).cast("string")
    for pattern, target in reversed(rules):
        value = F.regexp_replace(F.regexp_extract(F.col("file_name"), f"({pattern})", 1), pattern, target)
        rule = F.when(F.col("file_name").rlike(pattern), value).otherwise(rule)
    sidecar = F.coalesce(*[F.nullif(F.get_json_object("sidecar", p), F.lit("")) for p in ("$.Configuration.FunctionName", "$.FunctionName", "$.functionName")])
    clean, top = F.col("_clean"), F.col("top_entry")
    from_file = F.when((clean != "") & ~paths.looks_meaningless(clean), clean)
    from_zip = F.when(~top.rlike(r"\.(py|js|json|mjs|cjs)$") & ~paths.looks_meaningless(top), top)
    last = F.coalesce(F.nullif(clean, F.lit("")), F.nullif(F.col("_stem"), F.lit("")), F.lit("unknown"))
    fallback = F.when(paths.looks_meaningless(last), F.concat(F.lit("unknown-"), F.substring(paths.slugify(F.col("_stem"), "unnamed"), 1, 8))).otherwise(last)

    def step(value: Column, strategy: str, confidence: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("name"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence")))

    chain = F.coalesce(
        step(F.nullif(F.col("override"), F.lit("")), "explicit", "high"), step(F.col("_alias"), "alias", "high"), step(rule, "config-rule", "high"),
        step(sidecar, "sidecar-json", "high"), step(F.coalesce("_by_clean", "_by_stem"), "known-function", "high"),
        step(from_file, "filename", "medium"), step(from_zip, "zip-top-level", "low"), step(fallback, "fallback", "low"))
    return joined.withColumn("_id", chain).select(key, "file_name", "_id.name", "_id.strategy", "_id.confidence", paths.slugify(F.col("_id.name")).alias("slug"))
