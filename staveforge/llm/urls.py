"""URL filters (operator 12): host and path rules, and below them a weighted vocabulary that an Aho-Corasick automaton counts.

A term counts where it stands between boundaries, which are the ends of the URL and every ASCII character but letters
and digits. One strict term rejects a URL, and so do several different soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free

#: Rules of the query: host and path prefix, and the verdict.
RULES: tuple[tuple[str, str], ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: One of these rejects a URL.
STRICT: tuple[str, ...] = (
    "porn", "porno", "xxx", "hentai", "camgirls", "escorts", "nsfw", "onlyfans", "sexcam", "sexshop",
    "spam", "warez", "keygen", "malware", "phishing", "viagra", "cialis", "counterfeit", "fakeid", "darkweb",
    "free-bets", "online-casino", "payday-loans", "link-farm", "spam-farm",
)

#: SOFT_LIMIT different ones of these reject a URL.
SOFT: tuple[str, ...] = (
    "adult", "sex", "nude", "dating", "hot", "girls", "casino", "poker", "slots", "bet", "bets", "betting", "jackpot", "lottery",
    "free", "cheap", "bonus", "deal", "deals", "coupon", "promo", "discount", "win", "prize", "loan", "loans", "credit", "payday",
    "pills", "pharma", "weightloss", "replica", "torrent", "crack", "download", "mp3", "proxy", "seo", "backlinks", "farm",
)
SOFT_LIMIT = 2

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first `://`, A-Z lower-cased) and path (up to `?` or `#`); both empty for null or without `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    return host, tail[: min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))]


class Rules:
    """Host and path rules by host, longest first; a host stands for itself and all its subdomains."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            if not host or not slash or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {rule!r} {verdict!r}")
            self.by_host.setdefault(host.translate(_LOWER), []).append((rule, f"/{path}", verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones that of the longer host, then the smaller text."""
        best: tuple[int, str, str] | None = None
        while host:
            for rule, prefix, verdict in sorted(self.by_host.get(host, ())):
                if path.startswith(prefix) and (best is None or len(rule) > best[0]):
                    best = (len(rule), rule, verdict)
            host = host.partition(".")[2]
        return best and best[1:]


class Vocabulary:
    """Terms in one automaton; it is built once a task, so its size is that of the lists given."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):  # a term of both lists is strict
            for term in terms:
                low = term.translate(_LOWER)
                if not low:
                    raise ValueError("an empty term")
                self.found.add_word(low, (low, kind))
        if len(self.found):
            self.found.make_automaton()

    def terms(self, url: str | None) -> tuple[list[str], list[str]]:
        """The different strict and soft terms of a URL, sorted."""
        low = (url or "").translate(_LOWER)
        hit: dict[str, set[str]] = {"strict": set(), "soft": set()}
        for end, (term, kind) in self.found.iter(low) if len(self.found) else ():
            start = end + 1 - len(term)
            if not (start and _joins(low[start - 1])) and not (end + 1 < len(low) and _joins(low[end + 1])):
                hit[kind].add(term)
        return sorted(hit["strict"]), sorted(hit["soft"])


def _joins(c: str) -> bool:
    return c in _INSIDE or c > "\x7f"


_JUDGED = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string()))])
JUDGED = "struct<host:string,path:string,rule:string,verdict:string,strict:array<string>,soft:array<string>>"


def judge(pages: DataFrame, url_col: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, out: str = "judged") -> DataFrame:
    """pages with a struct (JUDGED) named out, or out and underscores where pages has that column (see common.free).

    The verdict is that of the longest rule that fits, else block for one strict term or soft_limit different soft
    ones, else allow. A null or empty URL, or one without `://`, has an empty host, fits no rule and is judged by its
    terms. Each row is judged alone, so repeated rows repeat their verdicts, and no row is moved to another task.
    """
    name, at = free(pages, out), pages.columns.index(url_col)
    Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, vocabulary = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(at).to_pylist():
                host, path = split_url(url)
                ruled = by_rule.find(host, path)
                hard, mild = vocabulary.terms(url)
                own = "block" if hard or len(mild) >= soft_limit else "allow"
                rows.append({"host": host, "path": path, "rule": ruled and ruled[0], "verdict": ruled[1] if ruled else own, "strict": hard, "soft": mild})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _JUDGED)], [*batch.schema.names, name])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.DataType.fromDDL(JUDGED))]))


def oracle(rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """Plain SQL for the columns of the op12 query: a test a rule, longest first, and a regular expression a term."""

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    def has(term: str) -> str:
        edge = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
        return f"regexp_matches(low, '(^|{edge}){term}($|{edge})')"

    order = sorted(rules, key=lambda r: -len(r[0]))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH u AS (SELECT page_id, {low.format("coalesce(url, '')")} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (SELECT page_id, low, {low.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in order)} END AS rule, CASE {" ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in order)} END AS ruled,
              {" + ".join(f"CAST({has(t)} AS BIGINT)" for t in strict)} AS n_strict, {" + ".join(f"CAST({has(t)} AS BIGINT)" for t in soft)} AS n_soft FROM p)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM r"""
