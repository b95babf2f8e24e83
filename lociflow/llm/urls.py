"""URL filter with a weighted vocabulary.

An Aho-Corasick automaton finds every term in the lower-cased URL; a hit counts where neither neighbour is a letter or
digit. One strict term rejects; so do several distinct soft terms whose weights add up to the limit; a term that repeats counts once. Rules on host and path
prefixes come first: the longest rule that fits decides.

Null URLs and URLs without `://` have an empty host and path; the vocabulary still reads the whole URL (a null one has
no hit). Empty tables give empty results; repeated rows are judged alike; a URL of any length is read whole. Two rules of the same
length that both fit are the same rule, so no tie remains. Input columns named like a new column are replaced; the
URL column may not have such a name.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.llm.common import LOWER, UPPER, with_text_udf

#: Terms of which one rejects.
STRICT = (
    "spam-farm", "spamfarm", "link-farm", "casino", "casinos", "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirl", "camgirls", "nsfw",
    "milf", "escorts", "hookup", "hookups", "warez", "keygen", "keygens", "nulled", "malware", "phishing", "ransomware", "botnet", "carding", "viagra",
    "cialis", "levitra", "slots", "jackpot", "roulette", "blackjack", "sportsbook", "betting", "payday-loan", "payday-loans",
)
#: Terms that add to a URL's weight, each once: 1 where good pages use it too, 3 where they seldom do.
SOFT = {
    "free": 1, "win": 1, "bonus": 2, "cheap": 2, "click": 1, "adult": 2, "sex": 3, "sexy": 3, "nude": 3, "dating": 2, "singles": 2, "crack": 2,
    "cracked": 3, "serial": 1, "torrent": 2, "torrents": 2, "magnet": 1, "download": 1, "bet": 2, "bets": 2, "poker": 3, "lottery": 2, "lotto": 3,
    "pills": 3, "pharmacy": 2, "drugs": 2, "weightloss": 3, "diet": 1, "loan": 2, "loans": 2, "credit": 1, "insurance": 1, "forex": 3, "crypto": 1,
    "airdrop": 3, "ads": 1, "ad": 1, "adserver": 3, "doubleclick": 2, "tracker": 1, "popup": 2, "promo": 1, "promocode": 2, "coupon": 1, "coupons": 1,
    "deal": 1, "deals": 1, "discount": 1, "sale": 1, "replica": 3, "outlet": 1, "spam": 2, "seo": 1, "backlinks": 3, "followers": 2, "winner": 2,
    "prize": 2, "giveaway": 2, "sweepstakes": 3, "clickbait": 3, "earn": 1, "rich": 1, "millionaire": 2, "mlm": 3,
}
#: Weight from which soft terms reject, which no term has alone.
SOFT_LIMIT = 4
#: (verdict, host, path) of the rules that come before the vocabulary.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def automaton(strict=STRICT, soft=None) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in {**(SOFT if soft is None else soft), **dict.fromkeys(strict, 0)}.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str | None, words: ahocorasick.Automaton) -> tuple[set[str], dict[str, int]]:
    """(strict terms, soft terms with their weights) that stand between boundaries in the URL."""
    low, strict, soft = (url or "").lower(), set(), {}
    for end, (term, weight) in words.iter(low):
        before, after = end - len(term), end + 1
        if (before < 0 or not low[before].isalnum()) and (after >= len(low) or not low[after].isalnum()):
            if weight:
                soft[term] = weight
            else:
                strict.add(term)
    return strict, soft


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased; both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, else null. A rule fits its host and all subdomains where the path starts with its own."""
    best = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k][1]) + len(rules[k][2])):
        _, own, start = rules[k]
        best = F.when(((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start)), F.lit(k)).otherwise(best)
    return best


def judge(df: DataFrame, url_col: str = "url", rules=RULES, soft_limit: int = SOFT_LIMIT, strict=STRICT, soft=None) -> DataFrame:
    """df with host, path, rule, verdict ('allow' or 'block'), n_strict and soft_weight."""
    terms = (tuple(strict), dict(SOFT if soft is None else soft))

    def run(urls: pa.Array) -> pa.Array:
        words = automaton(*terms)
        found = [hits(u, words) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(s) for s, _ in found], pa.int32()), pa.array([sum(w.values()) for _, w in found], pa.int32())], ["n_strict", "soft_weight"])

    made = with_text_udf(df, url_col, run, T.StructType([T.StructField("n_strict", T.IntegerType()), T.StructField("soft_weight", T.IntegerType())]))
    host, path = split_url(F.col(f"`{url_col}`"))
    made = made.withColumns({"host": host, "path": path})
    at = match_rule(F.col("host"), F.col("path"), rules)
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    own = F.when((F.col("n_strict") >= 1) | (F.col("soft_weight") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    made = made.withColumn("__at", at)
    return made.withColumns({"rule": F.when(F.col("__at").isNotNull(), F.get(names, F.col("__at"))), "verdict": F.when(F.col("__at").isNotNull(), F.get(verdicts, F.col("__at"))).otherwise(own)}).drop("__at")
