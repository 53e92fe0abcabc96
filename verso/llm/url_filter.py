"""URL filtering by host and path rules, and by a character language-model ratio for the rest.

Two smoothed variable-order Markov models over URL characters are trained, one on the URLs that the
rules allow and one on those that they block. A URL without a rule is judged by the difference of the
two log-likelihoods, divided by its length and compared with a threshold calibrated on a held-out fold
of the ruled URLs. Everything is DataFrame functions; there is no Python in the plan.

Size bounds: URL characters are folded to at most 34 symbols, so that a model has at most 34**3 rows
whatever the number of URLs. Only tables with that bound are broadcast.

Variable order means that contexts of two, one and no characters are mixed, each by how much was seen after it,
so that a context that training lacks falls back to the shorter one.

Null or malformed URLs have an empty host and path; they match no rule and are judged as the empty
string. If the rules leave one of the classes without training URLs, the method allows everything. Rows that
repeat an id or a URL are judged alike, one row each; of thresholds that separate the held-out URLs equally
well the one nearest to 0 counts, of two such the larger. A URL of any length is scored whole, in time in
proportion to its length. ``key`` may have any type; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, let

#: Fixed values: (host, path, verdict) of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, one sign for all digits, four signs of URLs, one for anything else, start and end.
SYMBOLS = 26 + 1 + 4 + 1 + 2
#: Calibration: every so many-th ruled URL is left out of training, and the score is cut into steps this wide.
CALIBRATION_FOLD, STEP, REACH = 5, 0.05, 100


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def folded(text: Column) -> Column:
    """The text over the model's alphabet, with two start signs and an end sign."""
    lowered = F.translate(text, UPPER, LOWER)
    plain = F.translate(F.regexp_replace(lowered, r"[^a-z0-9/._-]", "~"), "123456789", "000000000")
    return F.concat(F.lit("^^"), plain, F.lit("$"))


def grams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each character with its two predecessors; a text is cut into its characters once."""
    split = let(df.select(*keep, text), "gram_signs", F.split(text, ""))
    sign = lambda i: F.get(F.col("gram_signs"), i)
    places = F.sequence(F.lit(0), F.size("gram_signs") - 3)
    return split.select(*keep, F.explode(F.transform(places, lambda i: F.concat(sign(i), sign(i + 1), sign(i + 2)))).alias("g"))


def model(counts: DataFrame) -> DataFrame:
    """Log-probability difference (block - allow) of every symbol after every two symbols in ``counts``.

    ``counts``: ``g`` (three symbols), ``block`` and ``allow`` (training counts, 0 for grams that only
    untrained URLs have). Witten-Bell interpolation of orders 2, 1 and 0; order 0 is add-one smoothed. An
    unseen context falls back to the next shorter one.
    """
    parts = counts.select("g", F.substring("g", 1, 2).alias("xy"), F.substring("g", 2, 1).alias("y"), F.substring("g", 3, 1).alias("z"), "block", "allow")
    pairs = parts.groupBy("y", "z").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    singles = pairs.groupBy("z").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    everything = Window.partitionBy(F.lit(0))
    order0 = singles.select("z", *[((F.col(c) + 1.0) / (F.sum(c).over(everything) + SYMBOLS)).alias(f"p0_{c}") for c in ("block", "allow")])

    def context(of: DataFrame, key: str, tag: str) -> DataFrame:
        totals = [F.sum(c).alias(f"n{tag}_{c}") for c in ("block", "allow")]
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"t{tag}_{c}") for c in ("block", "allow")]
        return of.groupBy(key).agg(*totals, *kinds)

    def mixed(c: str, tag: str, lower: Column) -> Column:
        n, t = F.col(f"n{tag}_{c}"), F.col(f"t{tag}_{c}")
        return F.when(n > 0, (F.col(c) + t * lower) / (n + t)).otherwise(lower)

    order1 = pairs.join(context(pairs, "y", "1"), "y").join(order0, "z").select("y", "z", *[mixed(c, "1", F.col(f"p0_{c}")).alias(f"p1_{c}") for c in ("block", "allow")])
    order2 = parts.join(context(parts, "xy", "2"), "xy").join(order1, ["y", "z"])
    return order2.select("g", (F.log(mixed("block", "2", F.col("p1_block"))) - F.log(mixed("allow", "2", F.col("p1_allow")))).alias("llr"))


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    One shuffle of folded URLs for the scores (equal URLs are scored once) and one for attaching them;
    the models and the threshold are bounded by the alphabet.
    """
    base = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select(key, "host", "path", name.alias("rule"), verdict.alias("ruled"), folded(F.concat("host", "path")).alias("s"), (fold(key, CALIBRATION_FOLD) == 0).alias("held"))
    # Characters' rows carry a hash of their URL, whatever its length.
    base = base.withColumn("u", F.unhex(F.md5("s")))
    training = ~F.col("held")
    per_url = base.groupBy("u").agg(
        F.min("s").alias("s"),
        *[F.sum(((F.col("ruled") == c) & training).cast("long")).alias(c) for c in ("block", "allow")],
        *[F.sum(((F.col("ruled") == c) & F.col("held")).cast("long")).alias(f"held_{c}") for c in ("block", "allow")],
    ).select("u", "s", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("block", "allow", "held_block", "held_allow")])
    counts = grams(per_url, "s", "block", "allow").groupBy("g").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    scores = (
        grams(per_url, "s", "u", "block", "allow", "held_block", "held_allow")
        .join(F.broadcast(model(counts)), "g")
        .groupBy("u", "block", "allow", "held_block", "held_allow")
        .agg(F.avg("llr").alias("score"))
    )
    step = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.ceil(F.round(F.col("score") / STEP, 6)))).cast("int")
    histogram = scores.groupBy(step.alias("at")).agg(*[F.sum(c).alias(c) for c in ("block", "allow", "held_block", "held_allow")])
    upward = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    gain = F.sum("held_allow").over(upward) / F.greatest(F.sum("held_allow").over(whole), F.lit(1)) - F.sum("held_block").over(upward) / F.greatest(F.sum("held_block").over(whole), F.lit(1))
    ready = (F.sum("block").over(whole) > 0) & (F.sum("allow").over(whole) > 0)
    threshold = (
        histogram.select("at", gain.alias("gain"), ready.alias("ready"))
        .agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.abs("at")).alias("near"), F.col("at"))).getField("at").alias("cut"), F.first("ready").alias("ready"))
    )
    # One row: the threshold, null where there is nothing to compare with.
    limit = threshold.select(F.when(F.col("ready"), F.col("cut")).alias("cut")).scalar()
    judged = scores.select("u", F.coalesce(step > limit, F.lit(False)).alias("bad"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return base.join(judged, "u", "left").select(key, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


ORACLE = r"""
WITH base AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    '^^' || translate(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9/._-]', '~', 'g'), '123456789', '000000000') || '$' AS s
  FROM base),
verdicts AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v FROM ruled),
bits AS (SELECT b, (SELECT bit FROM (SELECT list_reduce(list_prepend(b::BIGINT, [i::BIGINT for i in range(8)]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS bit)) AS t FROM range(256) r(b)),
crc AS (SELECT list(t ORDER BY b) AS tab FROM bits),
folds AS (
  SELECT v.*, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(coalesce(page_id::VARCHAR, ''), '')]),
      lambda a, x: xor(a >> 8, tab[1 + xor(a, x) % 256])), 4294967295) % 5 = 0 AS held
  FROM verdicts v, crc),
per_url AS (
  SELECT s, count(*) FILTER (WHERE v = 'block' AND NOT held) AS nb, count(*) FILTER (WHERE v = 'allow' AND NOT held) AS na,
    count(*) FILTER (WHERE v = 'block' AND held) AS hb, count(*) FILTER (WHERE v = 'allow' AND held) AS ha
  FROM folds GROUP BY s),
g AS (SELECT s, nb, na, hb, ha, substr(s, i, 3) AS g FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM per_url)),
c AS (SELECT g, substr(g, 1, 2) AS xy, substr(g, 2, 1) AS y, substr(g, 3, 1) AS z, sum(nb) AS b, sum(na) AS a FROM g GROUP BY g),
p AS (SELECT y, z, sum(b) AS b, sum(a) AS a FROM c GROUP BY y, z),
o AS (SELECT z, (sum(b) + 1.0::DOUBLE) / ((SELECT sum(b) FROM c) + 34) AS pb, (sum(a) + 1.0::DOUBLE) / ((SELECT sum(a) FROM c) + 34) AS pa FROM p GROUP BY z),
c1 AS (SELECT y, sum(b) AS nb, sum(a) AS na, count(*) FILTER (WHERE b > 0) AS tb, count(*) FILTER (WHERE a > 0) AS ta FROM p GROUP BY y),
c2 AS (SELECT xy, sum(b) AS nb, sum(a) AS na, count(*) FILTER (WHERE b > 0) AS tb, count(*) FILTER (WHERE a > 0) AS ta FROM c GROUP BY xy),
o1 AS (SELECT y, z, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa
  FROM p JOIN c1 USING (y) JOIN o USING (z)),
llr AS (SELECT g, ln(CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END) - ln(CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END) AS d
  FROM c JOIN c2 USING (xy) JOIN o1 USING (y, z)),
scored AS (SELECT s, nb, na, hb, ha, greatest(-100, least(100, ceil(round(avg(d) / 0.05, 6))))::INT AS st FROM g JOIN llr USING (g) GROUP BY ALL),
hist AS (SELECT st, sum(nb) AS nb, sum(na) AS na, sum(hb) AS hb, sum(ha) AS ha FROM scored GROUP BY st),
gains AS (SELECT st, round(sum(ha) OVER (ORDER BY st) / greatest((SELECT sum(ha) FROM hist), 1)::DOUBLE - sum(hb) OVER (ORDER BY st) / greatest((SELECT sum(hb) FROM hist), 1)::DOUBLE, 9) AS gain FROM hist),
best AS (SELECT st AS cut, (SELECT sum(nb) > 0 AND sum(na) > 0 FROM hist) AS ready FROM gains ORDER BY gain DESC, abs(st), st DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN (SELECT ready FROM best) AND st > (SELECT cut FROM best) THEN 'block' ELSE 'allow' END) AS verdict
FROM folds LEFT JOIN scored USING (s)
"""


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
