"""URL filter: a weighted vocabulary matched by one automaton, after host rules.

The automaton (Aho-Corasick) finds all terms of a URL in one scan. A hit counts if
no ASCII letter or digit touches it. One strict term blocks; soft terms block when
the weights of the distinct ones reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import lower_ascii

# Terms and weights: parameters with these defaults.
STRICT = (
    "porn", "porno", "pornos", "porns", "xxx", "hentai", "escort", "escorts", "camgirl",
    "camgirls", "nsfw", "milf", "milfs", "bdsm", "hardcore-sex", "sexcam", "sexcams",
    "sexchat", "sexshop", "blowjob", "blowjobs", "bukkake", "gangbang", "creampie",
    "x-rated", "warez", "keygen", "keygens", "crackz", "viagra", "cialis", "levitra",
    "sildenafil", "tadalafil", "darkmarket", "carding", "malware-download",
)
# A term of weight 2 blocks alone: words that addresses of other matters hardly hold.
SOFT = {
    # adult
    "sex": 1, "sexy": 1, "adult": 2, "adults": 1, "adult-only": 2, "nude": 1, "nudes": 2,
    "naked": 1, "erotic": 1, "erotica": 2, "erotik": 2, "fetish": 1, "fetishes": 1, "dating": 1,
    "webcam": 1, "webcams": 1, "hookup": 1, "hookups": 2, "swingers": 2, "stripper": 2,
    "strippers": 2, "lingerie": 1,
    # gambling
    "casino": 1, "casinos": 2, "poker": 1, "bet": 1, "bets": 2, "betting": 1, "bookie": 2,
    "bookies": 2, "bookmaker": 2, "bookmakers": 2, "sportsbook": 2, "sportsbooks": 2,
    "slot": 1, "slots": 1, "jackpot": 1, "jackpots": 2, "roulette": 1, "blackjack": 1,
    "baccarat": 1, "bingo": 1, "keno": 1, "lotto": 1, "lottery": 1, "lotteries": 1,
    "gamble": 1, "gambling": 1, "gambler": 1, "wager": 1, "wagers": 1, "wagering": 2,
    "odds": 1, "win": 1, "winnings": 1,
    "bonus": 1, "bonuses": 1, "spins": 1,
    # pharmacy
    "pill": 1, "pills": 1, "pharmacy": 1, "pharmacies": 1, "meds": 1,
    "drugstore": 1, "no-prescription": 2, "tramadol": 2, "xanax": 2,
    "valium": 2, "ambien": 2, "phentermine": 2, "steroids": 1, "generic": 1,
    # money, goods, programs
    "payday": 1, "loan": 1, "loans": 1, "replica": 1, "replicas": 1, "cheap": 1,
    "torrent": 1, "torrents": 1, "cracked": 1, "serial-key": 1, "serial-keys": 1,
    "download-free": 1,
}
SOFT_THRESHOLD = 2

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next ``/ ? #``, A-Z lower-cased. Path:
    from there to the next ``? #``. Both are empty for null and without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.

    A rule is (verdict, host, path). It fits its host and all its subdomains where
    the path starts with the rule's."""
    text = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for decision, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        text = F.when(fits, own_host + own_path).otherwise(text)
        verdict = F.when(fits, decision).otherwise(verdict)
    return text, verdict


def _touches(character: str) -> bool:
    return "a" <= character <= "z" or "0" <= character <= "9"


def vocabulary_verdict(
    url: Column, strict: Iterable[str], soft: Mapping[str, int], threshold: int
) -> Column:
    weights = {term: threshold for term in strict}
    weights |= {term: weight for term, weight in soft.items() if term not in weights}

    @F.pandas_udf("string")
    def judged(urls: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()

        def verdict(text: str | None) -> str:
            hits = {}
            for end, (term, weight) in automaton.iter(text or ""):
                first = end - len(term) + 1
                if first and _touches(text[first - 1]):
                    continue
                if end + 1 < len(text) and _touches(text[end + 1]):
                    continue
                hits[term] = weight
            return "block" if sum(hits.values()) >= threshold else "allow"

        return pd.Series([verdict(text) for text in urls], dtype=object)

    return judged(lower_ascii(url)) if weights else F.lit("allow")


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Iterable[Rule] = (),
    strict: Iterable[str] = STRICT,
    soft: Mapping[str, int] = SOFT,
    threshold: int = SOFT_THRESHOLD,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the rows.

    The longest rule that fits decides; without one the vocabulary does. Columns of
    those names that the input has are replaced. A null or empty URL, or one without
    ``://``, has an empty host and path and fits no rule; null is allowed. Repeated
    rows each get their verdict, an empty table stays empty, URLs have no limit of
    length. Nothing is shuffled.
    """
    found = F.col(url)
    host, path = host_and_path(found)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = pages.select(
        *[F.col(c) for c in kept],
        host.alias("host"),
        path.alias("path"),
        vocabulary_verdict(found, strict, soft, threshold).alias("_by_words"),
    )
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parted.withColumns(
        {"rule": rule, "verdict": F.coalesce(verdict, F.col("_by_words"))}
    ).drop("_by_words")
