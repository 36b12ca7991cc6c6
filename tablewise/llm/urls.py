"""URL filter: host and path rules, and a weighted vocabulary of terms.

Terms are found by an Aho-Corasick automaton over the whole lower-cased url, and count where neither
neighbour is a letter or digit. One strict term rejects a url, and so do ``soft_hits`` different soft terms.
A rule for a host, its subdomains and the beginning of the path goes before the terms; the longest rule wins.

Each url is judged on its own: nothing is shuffled, and the rules and terms (parameters, not data) go to
the tasks with the code.

Defined cases: a null url, or one without ``://``, has an empty host and path; its terms are looked for all
the same, and nothing found means allow. Repeated rows are judged alike. An empty table gives an empty result. Input
columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import by_value

by_value(__name__)

#: Rules of the production query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of the production query: words of adult, fraudulent and spam sites, and of advertising that means little alone.
STRICT = (
    "adult", "adults", "bdsm", "blowjob", "camgirl", "camgirls", "camsex", "cumshot", "erotic", "erotica", "escort", "escorts", "fetish", "gangbang",
    "hardcore", "hentai", "hookup", "incest", "keygen", "keygens", "malware", "milf", "nsfw", "onlyfans", "phishing", "porn", "porno", "pornos",
    "pornhub", "pornography", "pornstar", "pornstars", "pornvideo", "pornvideos", "sexcam", "sexcams", "sexshop", "sexvideo", "sexvideos", "softcore",
    "spam", "spammer", "spyware", "stripper", "strippers", "swinger", "swingers", "topless", "torrent", "torrents", "trojan", "upskirt", "voyeur",
    "warez", "xvideos", "xxx",
)
SOFT = (
    "ads", "adserver", "babe", "babes", "bet", "bets", "betting", "bingo", "blackjack", "bonus", "brides", "cam", "cams", "cash", "casino", "casinos",
    "cheap", "cialis", "click", "coupon", "coupons", "crack", "cracked", "credit", "crypto", "dating", "deal", "deals", "discount", "discounts",
    "download", "downloads", "drugs", "enlargement", "forex", "free", "gambling", "gamble", "girls", "giveaway", "hot", "jackpot", "kamagra",
    "lesbian", "levitra", "loan", "loans", "lottery", "lucky", "mature", "mortgage", "naked", "nude", "nudes", "offer", "offers", "payday", "pharma",
    "pharmacy", "pill", "pills", "poker", "popup", "popups", "prize", "prizes", "promo", "promos", "replica", "replicas", "rich", "roulette",
    "serial", "sex", "sexy", "singles", "slot", "slots", "steroids", "strip", "teen", "teens", "track", "tracker", "tracking", "tramadol", "viagra",
    "vicodin", "vip", "voucher", "vouchers", "weight", "win", "winner", "winners", "wins",
)
SOFT_HITS = 2
NAMES = ["host", "path", "rule", "verdict", "n_strict", "n_soft"]

LOWER = {c: c + 32 for c in range(65, 91)}
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class Judge:
    def __init__(self, rules: Sequence[tuple[str, str, str]], strict: Sequence[str], soft: Sequence[str], soft_hits: int):
        import ahocorasick

        self.soft_hits = soft_hits
        self.rules: dict[str, list] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((len(host + path), path, host + path, verdict))
        self.terms = ahocorasick.Automaton()
        for kind, words in ((0, soft), (1, strict)):
            for w in words:
                self.terms.add_word(w, (w, kind))
        self.terms.make_automaton()

    def rule(self, host: str, path: str):
        """The longest rule that fits, or None."""
        fitting, at = [], 0
        while True:
            fitting += [r for r in self.rules.get(host[at:], ()) if path.startswith(r[1])]
            at = host.find(".", at) + 1
            if not at:
                return max(fitting, default=None)

    def hits(self, url: str | None) -> tuple[int, int]:
        """Strict hits, and different soft terms."""
        low, strict, soft = (url or "").translate(LOWER), 0, set()
        for end, (word, kind) in self.terms.iter(low):
            before, after = end - len(word), end + 1
            if (before < 0 or low[before] not in ALNUM) and (after == len(low) or low[after] not in ALNUM):
                strict += kind
                if not kind:
                    soft.add(word)
        return strict, len(soft)

    def __call__(self, url: str | None):
        host, path = parts(url)
        rule, (strict, soft) = self.rule(host, path), self.hits(url)
        verdict = rule[3] if rule else "block" if strict or soft >= self.soft_hits else "allow"
        return host, path, rule[2] if rule else None, verdict, strict, soft


def judged(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """The input with ``host, path, rule, verdict`` and the numbers of strict and different soft terms."""

    made = []  # the automaton, once for each task

    def run(urls: pa.Array) -> pa.Array:
        if not made:
            made.append(Judge(rules, strict, soft, soft_hits))
        judge = made[0]
        rows = [judge(u) for u in urls.to_pylist()]
        columns = list(zip(*rows)) or [()] * len(NAMES)
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

    udf = F.arrow_udf(run, "host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint").asNondeterministic()
    old = [F.col(f"`{c}`") for c in pages.columns if c not in NAMES]
    return pages.select(*old, udf(url).alias("_judged")).select(*old, "_judged.*")
