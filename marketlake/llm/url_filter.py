"""URL filters: host and path rules, then a weighted vocabulary found with Aho-Corasick.

A rule is a host with a path and a verdict. It fits its host and all subdomains where the url's path
starts with the rule's; the longest fitting rule decides (the longer text of host and path together;
on a tie the longer host). Where none fits, one pass of an Aho-Corasick automaton over the whole
lower-cased url finds the terms of the vocabulary; a hit counts only between characters that are
no letters or digits. One strict term, or SOFT_HITS distinct soft ones, block the url.

A null url, or one without ``://``, has an empty host and path and no rule; what text there is still
meets the vocabulary. Ties and repeated rows need no rule: every row is judged by itself.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict) of the rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: One of these blocks.
STRICT = ["adult", "casino", "escort", "hentai", "hookup", "porn", "porno", "sexcam", "spam", "viagra", "warez", "webcam-girls", "xxx"]
#: Several different ones of these block.
SOFT = ["ads", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "discount", "farm", "free", "gamble", "jackpot", "loan", "loans", "nude", "pill", "pills", "poker", "promo", "sexy", "slots", "track", "tracker", "win", "winner"]
SOFT_HITS = 2


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lowered, path); both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    end = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    return host, rest[:end]


class Judge:
    def __init__(self, rules: list[tuple[str, str, str]], strict: list[str], soft: list[str], soft_hits: int):
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.soft_hits = soft_hits
        self.terms = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.terms.add_word(term, (term, term in set(strict)))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: only the host and the domains above it are looked up."""
        best = None
        while host:
            for start, verdict in self.rules.get(host, ()):
                if path.startswith(start) and (best is None or (len(host) + len(start), len(host)) > best[0]):
                    best = (len(host) + len(start), len(host)), host + start, verdict
            host = host.partition(".")[2]
        return best and best[1:]

    def hits(self, url: str | None) -> tuple[int, int]:
        """(strict, soft): how many distinct terms of each kind stand between boundaries."""
        text, found = (url or "").lower(), set()
        if text and len(self.terms):
            for end, (term, strict) in self.terms.iter(text):
                start = end - len(term)
                if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    found.add((term, strict))
        strict = sum(s for _, s in found)
        return strict, len(found) - strict

    def verdict(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        """(host, path, rule, verdict, strict hits, soft hits)."""
        host, path = split_url(url)
        rule, (strict, soft) = self.rule(host, path), self.hits(url)
        verdict = rule[1] if rule else "block" if strict or soft >= self.soft_hits else "allow"
        return host, path, rule and rule[0], verdict, strict, soft


def judged(pages: DataFrame, rules=None, strict=None, soft=None, soft_hits: int = SOFT_HITS) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) of every row; only page_id and url are read."""
    given = (RULES if rules is None else rules, STRICT if strict is None else strict, SOFT if soft is None else soft, soft_hits)

    def run(it):
        judge = Judge(*given)
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        for b in it:
            found = [judge.verdict(u) for u in b.column("url").to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def oracle() -> str:
    """The same as SQL (boundaries there are those of ASCII)."""
    word = "[^\\p{L}\\p{N}]"

    def count(terms: list[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|{word}){t}({word}|$)') AS INTEGER)" for t in terms)

    fits = [f"(CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': {len(h + p)}, 'r': '{h + p}', 'v': '{v}'}} END)" for h, p, v in RULES]
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut),
ruled AS (
  SELECT *, list_sort([{", ".join(fits)}], 'DESC', 'NULLS LAST')[1] AS best,
    {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM parts)
SELECT page_id, host, path, best.r AS rule,
  coalesce(best.v, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM ruled"""
