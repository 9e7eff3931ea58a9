"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules judge a URL's host and path. A prefix rule (`example.net/en/`) fits its host
and all subdomains if the path starts with the rule's; the longest wins. Where none fits, the
method's verdict is that of the longest matching pattern, or `DEFAULT`. In a pattern `*` stands for any
text, `^` for a separator (no letter or digit) or either end; it may match anywhere in host and path.

Every rule is a regular expression that runs only on URLs with its index token: of the letter-digit
runs that any fitting URL must contain whole, the one that fewest URLs contain, counted over all of
them. A rule without such a run is tried on every URL. The rules are a parameter, sent to the tasks
in one closure of at most `MOST_RULE_BYTES`; a larger set is refused, never cut.

Defined results: a null URL and one without `://` have empty host and path. Ties of length go to the
rule with the longer host, then the lesser text. Repeated rows get equal verdicts. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW
MOST_RULE_BYTES = 64 << 20
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """text: `host/path` of a prefix rule, or a pattern."""

    verdict: str
    text: str
    pattern: bool = False

    def regex(self) -> str:
        if self.pattern:
            part = {"*": ".*", "^": r"(?:[^A-Za-z0-9]|\A|\Z)"}
            return "".join(part.get(c, re.escape(c)) for c in self.text)
        host, path = self._parts()
        return rf"\A(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}"

    def _parts(self) -> tuple[str, str]:
        host, slash, path = self.text.partition("/")
        return host, slash + path

    def tokens(self) -> set[str]:
        """Runs of letters and digits that a fitting URL contains whole."""
        # A prefix rule's host ends where the URL's does; a path or pattern may go on in the same run.
        text = self.text if self.pattern else f"^{self.text if '/' in self.text else self.text + '^'}"
        runs = re.finditer(TOKEN, text)
        closed = lambda i: 0 <= i < len(text) and text[i] != "*"
        return {m[0] for m in runs if closed(m.start() - 1) and closed(m.end())}

    def rank(self) -> tuple[int, int, str]:
        return -len(self.text), -len(self._parts()[0]), self.text


PREFIX_RULES = (
    Rule(BLOCK, "net/"),
    Rule(ALLOW, "example.net/en/"),
    Rule(BLOCK, "example.com/de/"),
    Rule(ALLOW, "org/fr/"),
)
# Names of hosts that gamble, sell drugs, or exist for adverts, spam or adult content.
PATTERN_RULES = tuple(
    Rule(BLOCK, f"^{name}^", True)
    for name in ("ads-track", "adult", "bets", "casino", "pills", "porn", "spam", "spam-farm", "xxx"))
RULES = PREFIX_RULES + PATTERN_RULES


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def token_counts(located: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; at most as many numbers as tokens."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    if not wanted:
        return {}
    found = F.array_intersect(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), 1), F.lit(wanted))
    counts = located.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in counts.collect()}


def indexed(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by rarest token; under the empty one those without any."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern, tried): tried counts the regular expressions that ran."""
    rules = list(dict.fromkeys(rules))
    if sum(len(r.text) for r in rules) > MOST_RULE_BYTES:
        raise ValueError(f"rules of more than {MOST_RULE_BYTES} bytes")
    host, path = parts(F.col(url).cast("string"))
    located = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    index = {t: [(r.rank(), r, r.regex()) for r in rs] for t, rs in indexed(rules, token_counts(located, rules)).items()}

    @F.pandas_udf("rule string, verdict string, pattern string, tried int")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {t: [(k, r, re.compile(x, re.S)) for k, r, x in rs] for t, rs in index.items()}
        run = re.compile(TOKEN)
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                tried, best = 0, {}
                for token in {"", *run.findall(h), *run.findall(p)}:
                    for rank, rule, regex in compiled.get(token, ()):
                        tried += 1
                        if regex.search(h + p) and (rule.pattern not in best or rank < best[rule.pattern][0]):
                            best[rule.pattern] = rank, rule
                prefix, pattern = (best[k][1] if k in best else None for k in (False, True))
                chosen = prefix or pattern
                out.append((prefix and prefix.text, chosen.verdict if chosen else DEFAULT, pattern and pattern.text, tried))
            yield pd.DataFrame(out, columns=["rule", "verdict", "pattern", "tried"])

    return located.withColumn("v", verdicts("host", "path")).select(
        F.col("id").alias(id_column), "host", "path", "v.rule", "v.verdict", "v.pattern", "v.tried")
