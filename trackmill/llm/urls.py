"""URL filter: host and path rules first, then a weighted vocabulary.

A rule names a host and the start of a path and fits that host and all its subdomains; the longest rule that fits decides.
Where none fits, an Aho-Corasick automaton finds the terms of a vocabulary (a table of terms and weights) in the whole address (A-Z lower-cased), a term counts
only between characters other than a-z and 0-9 (or the ends), and the address is blocked if the weights of its distinct terms
reach the limit: one strict term does, as do two soft ones.

Null addresses, and those without "://", have an empty host and path, so no rule fits them; a null address has no terms and is
allowed. The result has one row for each row of the input. Only the two named columns are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Weight of a strict and of a soft term; an address whose distinct terms weigh LIMIT or more is blocked.
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2, 1, 2
#: The vocabulary by language and kind, as it comes with the library; any table of term and weight does instead.
VOCABULARY = {
    ("en", "strict"): "adult casino escort malware phishing porn porno pornstar sexcam spam viagra cialis warez xxx",
    ("en", "soft"): "ads bet bets betting bonus cheap cheats clickbait crack cracked free gambling jackpot keygen loans lottery nude payday pills poker replica slots torrent track tracker win winner",
    ("de", "strict"): "erotik sexkontakte spielbank",
    ("de", "soft"): "gewinnspiel gluecksspiel gratis kredit kredite lotterie sportwetten wetten",
    ("fr", "strict"): "pornographie rencontres-sexe",
    ("fr", "soft"): "credit gratuit loterie paris-sportifs pari rachat-de-credit tirage",
    ("es", "strict"): "pornografia putas",
    ("es", "soft"): "apuestas apuesta credito loteria premios prestamos sorteo tragaperras",
}
#: Bounds of a vocabulary that is sent to every task: terms and their characters.
TERMS, TERM_CHARS = 1_000_000, 32_000_000


def vocabulary(spark: SparkSession) -> DataFrame:
    """lang, term, weight: the library's own vocabulary."""
    weight = {"strict": STRICT_WEIGHT, "soft": SOFT_WEIGHT}
    return spark.createDataFrame([(lang, term, weight[kind]) for (lang, kind), terms in VOCABULARY.items() for term in terms.split()], "lang string, term string, weight int")


def weights(terms: DataFrame) -> dict[str, int]:
    """The largest weight of each term (A-Z lower-cased) of a table; an error if the table is too large to send to every task. Null and empty terms don't count."""
    each = terms.select(F.translate("term", UPPER, LOWER).alias("term"), "weight").filter("term != '' AND weight IS NOT NULL").groupBy("term").agg(F.max("weight").alias("weight"))
    n, size = each.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n > TERMS or size > TERM_CHARS:
        raise ValueError(f"{n} terms of {size} characters are more than {TERMS} or {TERM_CHARS}")
    return {r["term"]: r["weight"] for r in each.collect()}


def host_of(url: Column) -> Column:
    return _after(url, r"^([^/?#]*)", True)


def _after(url: Column, pattern: str, lower: bool) -> Column:
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    found = F.regexp_extract(rest, pattern, 1)
    return F.when(F.instr(url, "://") > 0, F.translate(found, UPPER, LOWER) if lower else found).otherwise("")


def path_of(url: Column) -> Column:
    return _after(url, r"^[^/?#]*([^?#]*)", False)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, terms: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """key, host, path, rule, verdict, weight (of the distinct terms), terms (array, sorted)."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(weights(vocabulary(spark) if terms is None else terms))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import ahocorasick

        terms, found = held.value, ahocorasick.Automaton()
        for term in terms:
            found.add_word(term, term)
        found.make_automaton()
        edge = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")
        for batch in batches:
            hits = []
            for text in batch.column(4).to_pylist() if terms else [None] * batch.num_rows:
                hits.append(sorted({t for end, t in found.iter(text) if (end + 1 == len(text) or edge(text[end + 1])) and (end + 1 == len(t) or edge(text[end - len(t)]))}) if text else [])
            weight = [sum(terms[t] for t in h) for h in hits]
            verdict = [v or ("block" if w >= limit else "allow") for v, w in zip(batch.column(5).to_pylist(), weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(weight, pa.int64()), pa.array(hits, pa.list_(pa.string()))], names=[key, "host", "path", "rule", "verdict", "weight", "terms"])

    at = F.col(url).cast("string")
    host, path = host_of(at), path_of(at)
    split = pages.select(F.col(key), host.alias("__host"), path.alias("__path"), F.translate(at, UPPER, LOWER).alias("__low"))
    rule = rule_of(F.col("__host"), F.col("__path"), rules)
    return split.select(key, "__host", "__path", rule.alias("__rule"), "__low").select(key, "__host", "__path", F.col("__rule.rule"), "__low", F.col("__rule.verdict").alias("__verdict")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, weight long, terms array<string>")


def judge_sql(rules=RULES) -> str:
    """The same for DuckDB over `pages`, by one regular expression for each term."""
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)))
    terms = {t: STRICT_WEIGHT if kind == "strict" else SOFT_WEIGHT for (_, kind), own in sorted(VOCABULARY.items(), key=lambda x: x[0][1]) for t in own.split()}
    weight = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in sorted(terms.items()))
    names = ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in sorted(terms))
    return f"""
WITH a AS (SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {case} END AS fit, CAST({weight} AS BIGINT) AS weight, array_to_string([x FOR x IN [{names}] IF x IS NOT NULL], ',') AS terms FROM b)
SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, CASE WHEN fit IS NULL THEN CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END ELSE split_part(fit, '|', 2) END AS verdict, weight, terms FROM c
"""
