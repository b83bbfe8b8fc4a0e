"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one Shift-And automaton of several 64-bit words. A rule's characters
are consecutive bits; `*` is a bit that stays set, `?` a bit that any character sets. Each task runs
the automaton over a batch of URLs at once, one character position a step, so the work is
(characters) x (words of rules), whatever the number of rules that match.

A canonical URL is `scheme#host#path#query`. None of the four parts can hold `#`, so a rule with
three `#` is aligned with the parts. The fragment is dropped.

Defined results: a null url and one without `://` have an empty host and path; so has `://` at the
end. Empty tables give empty tables. Rows are judged one by one, so repeated rows give repeated
results. Of the input only the id and the url are read; other columns can have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*\Z")
UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with all its subdomains, and paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"*#{self.host}#{self.path}*#*", f"*#*.{self.host}#{self.path}*#*"


#: The allow and block list by host and path.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: What is blocked where no host rule fits: URLs without a host, sign-in and shop pages, ad hosts, binaries.
BLOCK_GLOBS = (
    "*##*#*", "*#*#*/login*#*", "*#*#*/signup*#*", "*#*#*/wp-admin/*#*", "*#*#*/cart*#*", "*#*#*/checkout*#*",
    "*#ads.*#*#*", "*#ad?.*#*#*", "*#*casino*#*#*", "*#*porn*#*#*", "*#*#*.exe#*", "*#*#*.zip#*", "*#*#*.tar.gz#*",
    "*#*#*.iso#*", "*#*#*.apk#*", "*#*#*#*sessionid=*",
)


def split_url(url: str | None) -> tuple[str, str, str]:
    """(canonical, host, path) of a url."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "###", "", ""
    rest = rest.split("#", 1)[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    host, path = host.translate(UPPER), slash + path
    return f"{head.lower() if SCHEME.match(head) else ''}#{host}#{path}#{query}", host, path


class Automaton:
    """Shift-And over several words for all globs at once."""

    def __init__(self, globs: Sequence[str]):
        states: list[tuple[str | None, bool]] = []  # what sets the bit (None: nothing, a start), and whether it stays
        start, final = [], []
        for glob in globs:
            start.append(len(states))
            states.append((None, False))
            for c in glob:
                if c == "*":
                    states[-1] = (states[-1][0], True)
                else:
                    states.append((c, False))
            final.append(len(states) - 1)
        words = (len(states) + 63) // 64
        self.alphabet = np.array(sorted({ord(c) for c, _ in states if c and c != "?"}), np.uint32)
        where = {int(c): k + 1 for k, c in enumerate(self.alphabet)}
        self.sets = np.zeros((len(self.alphabet) + 1, words), np.uint64)  # row 0: a character of no rule
        self.stays, self.start = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for k, (c, stays) in enumerate(states):
            bit = np.uint64(1 << (k % 64))
            if c == "?":
                self.sets[:, k // 64] |= bit
            elif c is not None:
                self.sets[where[ord(c)], k // 64] |= bit
            if stays:
                self.stays[k // 64] |= bit
        for k in start:
            self.start[k // 64] |= np.uint64(1 << (k % 64))
        self.final = [(k // 64, np.uint64(1 << (k % 64))) for k in final]

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean (texts, globs): which glob matches which whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        k = np.searchsorted(self.alphabet, points)
        k[k == len(self.alphabet)] = 0
        codes = np.where(self.alphabet[k] == points, k + 1, 0) if len(points) else points
        begins = (ends - lengths)[order]
        left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # longer than t: the first so many
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(left):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.sets[codes[begins[:n] + t]]) | (now & self.stays)
        out = np.empty((len(texts), len(self.final)), bool)
        for j, (word, bit) in enumerate(self.final):
            out[order, j] = (state[:, word] & bit) != 0
        return out


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[HostRule] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Judge every url: (id, host, path, rule, verdict).

    Of the host rules that fit, the longest wins (equally long ones: the first in the list). Where
    none fits, rule is null and the url is blocked if any of block_globs matches, else allowed.
    """
    by_length = sorted(host_rules, key=lambda r: -len(r.name))  # stable
    globs = [g for r in by_length for g in r.globs] + list(block_globs)
    n_rules = len(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        names = np.array([r.name for r in by_length] + [None], object)
        verdicts = np.array([r.verdict for r in by_length] + [None], object)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = automaton.match([s[0] for s in split])
            fits = hit[:, : 2 * n_rules].reshape(-1, n_rules, 2).any(axis=2)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1) if n_rules else 0, n_rules)
            verdict = np.where(first < n_rules, verdicts[first], np.where(hit[:, 2 * n_rules :].any(axis=1), "block", "allow"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s[1] for s in split], pa.string()), pa.array([s[2] for s in split], pa.string()), pa.array(names[first], pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    rows = df.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _like(glob: str) -> str:
    return glob.replace("~", "~~").replace("%", "~%").replace("_", "~_").replace("*", "%").replace("?", "_").replace("'", "''")


def oracle(host_rules: Sequence[HostRule] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> str:
    """DuckDB SQL for judge_urls over pages."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = sorted(host_rules, key=lambda r: -len(r.name))
    fits = [f"(({' OR '.join([f'host = {chr(39)}{r.host}{chr(39)}', f'ends_with(host, {chr(39)}.{r.host}{chr(39)})'])}) AND starts_with(path, '{r.path}'))" for r in rules]
    blocked = " OR ".join(f"canonical LIKE '{_like(g)}' ESCAPE '~'" for g in block_globs) or "false"
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, 1, strpos(url, '://') - 1) END AS head FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '') AS query,
         CASE WHEN regexp_full_match(head, '[A-Za-z][A-Za-z0-9+.-]*') THEN lower(head) ELSE '' END AS scheme FROM rest),
whole AS (SELECT *, scheme || '#' || host || '#' || path || '#' || query AS canonical FROM parts)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules))} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules))} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM whole"""
