"""URL filters: many pattern rules, indexed by the rarest literal token of each.

A rule's pattern is compiled to a regular expression, and from its literal parts come the tokens that every URL it fits
must hold as whole words. How many URLs hold each of these tokens is counted over all URLs, and the rule is filed under
its rarest one. A URL's tokens then fetch the rules that can fit at all, and only their expressions run. Rules without a
whole literal token are candidates for every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices

ALLOW, BLOCK = "allow", "block"
#: Rules are sent to every task: more than this are refused, so their size has a bound.
MOST_RULES = 1_000_000

_TOKEN = re.compile("[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A pattern and its verdict; a site rule (host and path) decides before all others.

    Patterns are held against host and path, A-Z in lower case for all but site rules' paths: ``*`` is any text, ``^`` a
    character other than a letter or digit, or the end; ``||`` in front is the beginning of the host or of any label of
    it. A site rule ``host/path`` fits the host and its subdomains where the path begins with its own.
    """

    pattern: str
    verdict: str = BLOCK
    site: bool = False

    def expression(self) -> str:
        if self.site:
            return rf"(?s)\A(?:[^/]*\.)?{re.escape(self.pattern)}"
        body = self.pattern.removeprefix("||")
        parts = {"*": ".*", "^": r"(?:[^a-z0-9]|\Z)"}
        return "(?s)" + (r"\A(?:[^/]*\.)?" if body != self.pattern else "") + "".join(parts.get(c) or re.escape(c) for c in body)

    def tokens(self) -> list[str]:
        """Tokens that are whole ones in every fitting URL: letters and digits with an end on both sides."""
        anchored = self.site or self.pattern.startswith("||")
        body = self.pattern.removeprefix("||").translate(_LOWER)
        last = len(body)
        ended = lambda at: at >= 0 and at < last and body[at] != "*"  # noqa: E731  any other character, as tokens are maximal
        return [m[0] for m in _TOKEN.finditer(body) if (ended(m.start() - 1) or (anchored and m.start() == 0)) and ended(m.end())]


# The site rules, and names of trades that are blocked where no site rule fits.
SITE_RULES = (Rule("net/", BLOCK, True), Rule("example.net/en/", ALLOW, True), Rule("example.com/de/", BLOCK, True), Rule("org/fr/", ALLOW, True))
TRADES = (
    "adult", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gambling", "jackpot", "lottery", "malware", "payday", "phishing", "pills", "poker", "porn", "replica", "roulette", "sex",
    "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
ADVERTS = ("ad", "ads", "adserver", "adtrack", "banners", "clicktrack", "doubleclick", "popads", "tracker")
PATTERN_RULES = (
    *[Rule(f"||{w}^") for w in TRADES],
    *[Rule(f"||{w}{sep}") for w in ADVERTS for sep in ".-"],
    *[Rule(f"||*-{w}{sep}") for w in TRADES for sep in ".-"],
    *[Rule(f"/{w}/") for w in (*TRADES, *ADVERTS)],
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path of a URL; both are empty without ``://`` or a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    # No built-in finds the first of several characters: what follows the first of them is cut off.
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many rows of (host, path) hold each token that a rule could be filed under: one count for each such token."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    if not wanted:
        return {}
    text = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.array_intersect(F.split(text, "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    counted = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {token: n for token, n in counted}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
        self.rules = list(rules)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, rule in enumerate(self.rules):
            tokens = rule.tokens()
            (self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))] if tokens else self.always).append(i)
        self._compiled: dict[int, re.Pattern] = {}

    def fits(self, i: int, text: str, lower: str) -> bool:
        pattern = self._compiled.get(i) or self._compiled.setdefault(i, re.compile(self.rules[i].expression()))
        return pattern.search(text if self.rules[i].site else lower) is not None

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None, int]:
        """(site rule, verdict, the rule of the others that decides, number of candidates).

        The longest fitting rule wins, of equally long ones the first in text order.
        """
        text = host + path
        lower = text.translate(_LOWER)
        candidates = [i for t in set(_TOKEN.findall(lower)) for i in self.by_token.get(t, ())] + self.always
        site = other = None
        for i in candidates:
            rule = self.rules[i]
            best = site if rule.site else other
            if (best is None or (-len(rule.pattern), rule.pattern) < (-len(best.pattern), best.pattern)) and self.fits(i, text, lower):
                site, other = (rule, other) if rule.site else (site, rule)
        deciding = site or other
        return site.pattern if site else None, deciding.verdict if deciding else ALLOW, other.pattern if other and not site else None, len(candidates)


def _judge(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [index.judge(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "rule", "verdict", "pattern", "n_candidates"])

    return run


def judge(pages: DataFrame, rules: Sequence[Rule] = (*SITE_RULES, *PATTERN_RULES), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern, n_candidates) of each row of ``pages``.

    ``rule`` is the site rule that decides (null: none), ``pattern`` the one of the others that does where no site rule
    fits; where none fits at all the verdict is ``allow``. A null URL and one without ``://`` have an empty host and path,
    which no rule with a token fits. Null ids stay null, repeated rows give repeated rows, an empty table gives none, and
    other columns don't matter. Rows are judged where they lie; only the tokens of rules are counted over all of them.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    index = Index(rules, token_counts(parsed, rules))
    kind = parsed.schema["page_id"].dataType.simpleString()
    return parsed.mapInArrow(_judge(index), f"page_id {kind}, host string, path string, rule string, verdict string, pattern string, n_candidates int")
