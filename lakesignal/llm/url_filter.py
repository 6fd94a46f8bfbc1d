"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick pass over a percent-decoded url finds strict and soft terms; a
hit, with or without an s at its end, counts only if no letter or digit stands
beside it. A strict hit weighs as much as several distinct soft terms; that
weight rejects the url.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these rejects a url. A space in a term stands for any single character that is no letter or digit.
STRICT_TERMS = (
    "adult cam", "adult chat", "adult friend", "adult movie", "adult toy", "adult video", "adult x", "anal sex", "bestiality", "blowjob",
    "bukkake", "cam girl", "cam sex", "camgirl", "camsex", "child porn", "creampie", "cumshot", "dildo", "erotica", "fetish sex", "gangbang",
    "gay sex", "gore video", "handjob", "hardcore sex", "hentai", "hot milf", "incest", "jailbait", "live sex", "lolita sex", "milf", "nsfw",
    "nude pic", "nude teen", "nudist pic", "online sex", "oral sex", "phone sex", "porn", "porn tube", "porno", "pornhub", "pornography",
    "pornstar", "rule34", "sex cam", "sex chat", "sex doll", "sex movie", "sex shop", "sex tape", "sex toy", "sex video", "sextoy", "shemale",
    "slut", "snuff film", "snuff video", "softcore", "swinger club", "teen sex", "threesome", "tits", "upskirt", "voyeur cam", "webcam sex",
    "whore", "x rated", "xnxx", "xvideo", "xxx", "zoophilia",
)
#: SOFT_LIMIT distinct ones of these reject a url.
SOFT_TERMS = (
    "18 plus", "adult", "babe", "baccarat", "bet", "betting", "bingo", "blackjack", "bonus", "bookie", "bookmaker", "cash", "casino",
    "cheap", "cialis", "crack", "cracked", "dating", "debt", "erotic", "escort", "fetish", "forex", "free", "fuck", "gambling", "gore",
    "hack", "hacked", "hookup", "jackpot", "keygen", "kinky", "levitra", "lingerie", "loan", "lottery", "lotto", "lucky", "meds",
    "mortgage", "naked", "nude", "payday", "pharmacy", "pill", "poker", "prescription", "prize", "replica", "roulette", "seduction",
    "sex", "sexy", "slot", "sportsbook", "steroid", "stripper", "torrent", "tramadol", "valium", "viagra", "voyeur", "wager", "warez",
    "webcam", "weight loss", "win", "winner", "xanax",
)
SOFT_LIMIT = 2
GAP = re.compile("[^a-z0-9]")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains if the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


OP7_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def automaton_of(strict, soft) -> ahocorasick.Automaton:
    """The terms and their plurals; a term that is strict and soft is strict."""
    out = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):
        for t in terms:
            out.add_word(t, (t, len(t), is_strict))
            out.add_word(t + "s", (t, len(t) + 1, is_strict))
    out.make_automaton()
    return out


def term_counts(urls: Column, strict=STRICT_TERMS, soft=SOFT_TERMS) -> Column:
    """struct<strict: distinct strict terms, soft: distinct soft terms> of urls; null counts none.

    Urls are percent-decoded once and lower-cased; what is no ASCII letter or
    digit then counts as a gap.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.arrow_udf("struct<strict: bigint, soft: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = automaton_of(strict, soft).iter if strict or soft else lambda _: ()
        for batch in batches:
            out = []
            for url in batch.to_pylist():
                text, seen = f" {GAP.sub(' ', unquote(url or '').translate(LOWER))} ", {}
                for end, (t, size, is_strict) in find(text):
                    if text[end - size] == " " and text[end + 1] == " ":
                        seen[t] = is_strict
                n = sum(seen.values())
                out.append({"strict": n, "soft": len(seen) - n})
            yield pa.array(out, pa.struct([("strict", pa.int64()), ("soft", pa.int64())]))

    return count(urls)


def url_filter(
    pages: DataFrame,
    rules=(),
    strict=STRICT_TERMS,
    soft=SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every row's url: id, host, path, rule, verdict, strict_terms, soft_terms.

    The host stands after the first ``://``, A-Z lower-cased, the path after it
    up to ``?`` or ``#``; a null url, or one without ``://``, has neither, and
    no rule fits it. Of the rules that fit, the longest wins (equal lengths:
    the longer host, then block before allow); else the vocabulary decides over
    the whole url: each strict term weighs soft_limit, each soft term 1, and a
    weight of soft_limit blocks. Null and empty urls have no terms and are
    allowed; urls may be of any length. Rows are judged one by one: repeated
    rows and ids stay, extra columns are ignored. An empty table gives none.
    """
    url = F.col(url_col)
    parts = "://([^/?#]*)([^?#]*)"
    rows = pages.select(
        F.col(id_col),
        ascii_lower(F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"),
        term_counts(url, strict, soft).alias("terms"),
    )
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    text, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, said = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(said)
    bad = F.col("terms.strict") * soft_limit + F.col("terms.soft") >= soft_limit
    return rows.select(
        id_col,
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(said, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("terms.strict").alias("strict_terms"),
        F.col("terms.soft").alias("soft_terms"),
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url under the contract's rules and the module's vocabulary."""
    from .common import table

    return url_filter(table(spark, sf_dir, "pages"), OP7_RULES).drop("strict_terms", "soft_terms")


def _hit(term: str) -> str:
    """SQL: whether the text holds the term between gaps; a space stands for any gap."""
    return f"contains(gaps, ' {term} ') OR contains(gaps, ' {term}s ')"


OP7_SQL = f"""
WITH u AS (
  SELECT page_id, ' ' || regexp_replace(translate(url_decode(coalesce(url, '')), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                                        '[^a-z0-9]', ' ', 'g') || ' ' AS gaps,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in OP7_RULES)}
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS said
  FROM u JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
       coalesce(said, CASE WHEN {" OR ".join(map(_hit, STRICT_TERMS))}
         OR {" + ".join(f"CAST({_hit(t)} AS INTEGER)" for t in SOFT_TERMS)} >= {SOFT_LIMIT}
         THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)
"""
