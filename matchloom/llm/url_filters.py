"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the few rules that are then run."""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, utf8

TOKEN = re.compile(r"[a-z0-9]+")
#: Bytes of rules in one broadcast; a larger set is applied in several passes over the URLs.
SLICE_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """``place`` rules hold for a host, its subdomains and the paths that start so (``host/path``); ``pattern`` rules are
    regular expressions on the whole URL in lower case (A-Z)."""

    action: str
    text: str
    kind: str = "place"

    def regex(self) -> str:
        return r"(?:[^/]*\.)?" + re.escape(self.text) if self.kind == "place" else self.text

    def keys(self) -> set[frozenset[str]]:
        """Ways to fit, each with the tokens that any URL that fits so has: runs of letters and digits between other
        characters or the URL's ends. Alternatives and what may be left out are ways of their own; what a pattern varies
        further (classes, repeats) gives no token."""
        if self.kind == "place":
            low = self.text.lower()
            whole = low if not TOKEN.match(low[-1:]) else low[: -len(TOKEN.findall(low)[-1])]  # a path may go on
            return {frozenset(TOKEN.findall(whole))}
        ways = set()
        for way in spelled(parser.parse(self.text)):
            runs, own, whole = set(), "", False  # a pattern's open ends may lie within a token
            for item in (*way, VARIES):
                if len(item) == 1 and TOKEN.fullmatch(item):
                    own += item
                    continue
                if own and whole and item in (EDGE, MARK):
                    runs.add(own)
                own, whole = "", item in (EDGE, MARK)
            ways.add(frozenset(runs))
        return {w for w in ways if not any(other < w for other in ways)}  # a way with fewer tokens fetches for the others


EDGE, MARK, VARIES = "edge", "mark", "varies"
#: Ways of one pattern that are told apart; where it has more, the part that makes them counts as varying.
WAYS = 256


def spelled(parts) -> set[tuple[str, ...]]:
    """The ways to spell a parsed pattern, as characters (letters and digits), marks (one other character), edges (^ and $)
    and what varies."""
    out: set[tuple[str, ...]] = {()}
    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            own = {(chr(arg) if TOKEN.fullmatch(chr(arg)) else MARK,)}
        elif name == "AT":
            own = {(EDGE if str(arg) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING") else VARIES,)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            own = {(chr(a) if TOKEN.fullmatch(chr(a)) else MARK,) for _, a in arg}
        elif name == "SUBPATTERN":
            own = spelled(arg[-1])
        elif name == "BRANCH":
            own = set().union(*map(spelled, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and tuple(arg[:2]) == (0, 1):
            own = {(), *spelled(arg[2])}
        else:
            own = {(VARIES,)}
        if len(out) * len(own) > WAYS:
            own = {(VARIES,)}
        out = {x + y for x in out for y in own}
    return out


#: Place rules, as given, and patterns for pages that repeat others: listings, feeds, sessions, log-ins, downloads, ads.
PLACES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))
PATTERNS = tuple(
    Rule("block", text, "pattern")
    for text in (
        r"[?&]page=[0-9]+&ref=",
        r"[?&]utm_source=feed(?:&|#|$)",
        r"[?&]sessionid=[0-9a-f]+(?:&|#|$)",
        r"/wp-login\.php(?:\?|#|$)",
        r"/cgi-bin/",
        r"/(?:login|signin|register)(?:/|\?|#|$)",
        r"\.exe(?:\?|#|$)",
        r"://ads?\.",
    )
) + (Rule("allow", r"://docs\.[^/]+/reference/", "pattern"),)


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, whole URL in lower case): only A-Z are lowered; without ``://`` host and path are empty."""
    url = url or ""
    whole = url.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = url.find("://")
    if at < 0:
        return "", "", whole
    rest = url[at + 3 :]
    end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = re.match(r"[^?#]*", rest[end:])[0]
    return whole[at + 3 : at + 3 + end], path, whole


def token_counts(pages: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; tasks count for themselves, so only the rules' tokens are shuffled."""
    shared = pages.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        known, n = shared.value, Counter()
        for batch in batches:
            for url in utf8(batch.column("url")):
                n.update(known.intersection(TOKEN.findall((url or b"").lower().decode("utf-8", "replace"))))
        if n:
            yield batch_of(schema, (list(n), list(n.values())))

    rows = pages.select("url").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}


def token_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> numbers of the rules that it fetches: the rarest token of each way to fit. A rule that has a way without
    any token is under "" and meets every URL."""
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for way in rule.keys():
            token = min(way, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            if k not in index.setdefault(token, []):
                index[token].append(k)
    return index


def slices(rules: Sequence[Rule]) -> list[list[Rule]]:
    out: list[list[Rule]] = [[]]
    room = SLICE_BYTES
    for rule in rules:
        cost = 200 + 4 * len(rule.text)
        if out[-1] and cost > room:
            out.append([])
            room = SLICE_BYTES
        out[-1].append(rule)
        room -= cost
    return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = PLACES + PATTERNS) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern``: the longest place rule that fits decides (of equal ones the first
    by text); else a page is blocked if a blocking pattern fits and no allowing one does; else it is allowed.

    A null URL, an empty one and one without ``://`` have an empty host and path; patterns still see the whole URL. No
    shuffle carries URLs, so a host with any share of the pages makes no large task. Repeated rows are judged alike, a null
    page_id is kept, an empty table gives no rows, and other columns are ignored, whatever their names. Rules and their
    tokens are broadcast in slices of bounded size, each with a pass over the URLs."""
    out = pages.select("page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    parts = slices(rules)
    fields = "page_id long, url string, rule string, verdict string, pattern string"
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "rule", "verdict", "pattern"))])
    for part in parts:
        counts = token_counts(pages, {t for r in part for way in r.keys() for t in way})
        shared = pages.sparkSession.sparkContext.broadcast((part, token_index(part, counts)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rules, index = shared.value
            tests = [re.compile(r.regex()) for r in rules]
            always = index.get("", [])
            for batch in batches:
                rows = [[], [], []]
                held = zip(*(batch.column(c).to_pylist() for c in ("url", "rule", "verdict", "pattern")), strict=True)
                for url, rule, verdict, pattern in held:
                    host, path, whole = split_url(url)
                    best = rule and (-len(rule), rule, verdict)
                    for k in {*always, *(k for t in set(TOKEN.findall(whole)) for k in index.get(t, ()))}:
                        own = rules[k]
                        if own.kind == "place":
                            key = (-len(own.text), own.text, own.action)
                            if (not best or key < best) and tests[k].match(host + path):
                                best = key
                        elif (key := f"{own.action} {own.text}") < (pattern or "c") and tests[k].search(whole):
                            pattern = key  # allow comes before block, then the first by text
                    for column, value in zip(rows, (best and best[1], best and best[2], pattern), strict=True):
                        column.append(value or None)
                yield batch_of(schema, (batch.column("page_id"), batch.column("url"), *rows))

        out = out.mapInArrow(run, fields)
    ends = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict", "pattern"))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for url in batch.column("url").to_pylist():
                host, path, _ = split_url(url)
                hosts.append(host)
                paths.append(path)
            verdicts = [v or ("block" if (p or "").startswith("block") else "allow") for v, p in zip(batch.column("verdict").to_pylist(), batch.column("pattern").to_pylist(), strict=True)]
            yield batch_of(ends, (batch.column("page_id"), hosts, paths, batch.column("rule"), verdicts, batch.column("pattern")))

    return out.mapInArrow(finish, "page_id long, host string, path string, rule string, verdict string, pattern string")


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, whole, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), places(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM split) JOIN places ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), patterns(action, text) AS (
  VALUES {patterns}
), hits AS (
  SELECT page_id, whole, min(p.action || ' ' || p.text) AS pattern FROM (SELECT DISTINCT page_id, whole FROM split) JOIN patterns p ON regexp_matches(whole, p.text) GROUP BY page_id, whole
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, CASE WHEN starts_with(h.pattern, 'block') THEN 'block' ELSE 'allow' END) AS verdict, h.pattern
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path AND f.place = 1
LEFT JOIN hits h ON h.page_id = s.page_id AND h.whole = s.whole
""".replace("{patterns}", ", ".join(f"('{r.action}', '{r.text}')" for r in PATTERNS))
