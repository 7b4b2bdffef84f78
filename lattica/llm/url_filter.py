"""URL filtering: fixed rules by host and path, then association rules mined from labels.

A URL's tokens are the labels of its host, its registered name, and the shapes of its path segments and query keys.
FP-growth mines frequent token sets with their numbers of bad and good URLs over the labelled URLs; rules
`tokens -> bad` (block) and `tokens -> good` (allow) are kept if their support and confidence are high enough and no rule
of the same verdict on fewer of the tokens is as sure. The rules are matched by an inverted index from each rule's rarest
token, and the surest that matches decides; URLs that none matches are allowed. Fixed rules (host, path) come first: a
rule fits its host and all subdomains if the URL's path starts with the rule's; the longest that fits decides.

Mining drops no rule at the support: all frequent items of all URLs take part. Tokens that always come together are one
item (so that a site's template of many constant segments is one item). FP-growth is dealt over the cluster by each set's
rarest item: a worker grows its sets from the URLs that have that item. Sets are not grown where no rule can be kept: by an
item that all URLs of the set have (the smaller set is as sure), and beyond sets whose URLs are all bad or all good. What
is left depends on the data: items without order among them, many to a URL, still have many frequent sets.

A page's label is that of the document whose id is the last number in its path: in the given tables the page's article is
that document's text.

Defined cases: a null URL, or one without ://, has an empty host and path and no tokens, fits no rule and is allowed.
Several labels of one document count as one row each. Without labels nothing is mined. Repeated rows are judged alike.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: Least share of the labelled URLs that hold a rule's tokens and have its label, and least share of that label among those that hold them.
SUPPORT, CONFIDENCE = 0.005, 0.6
#: The same share's lower bound (Wilson, this many standard errors) must be SURE at least, so that chance on few URLs makes no rule.
ERRORS, SURE = 3.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def tokens(url: Column) -> Column:
    """Distinct tokens: h:<label of the host>, d:<its last two labels>, p:<path segment>, x:<file ending>, q:<query key>; numbers are #."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    name = F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    steps = F.filter(F.split(F.regexp_replace(path, r"\.\w{1,5}$", ""), "/"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.(\w{1,5})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    shaped = F.transform(steps, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "#")))
    found = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.when(F.size(labels) > 0, F.array(name)).otherwise(F.array().cast("array<string>")), shaped, F.when(ending != "", F.array(F.concat(F.lit("x:"), ending))).otherwise(F.array().cast("array<string>")), F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_distinct(found)


class Rule(NamedTuple):
    tokens: frozenset[str]
    confidence: float
    support: float
    verdict: str
    lift: float


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, tokens and bad of every pair of a page and a label of its document."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("__doc"), F.coalesce(bad, F.lit(False)).alias("bad"))
    seen = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"(\d+)\D*$", 1).alias("__doc")).where("__doc <> ''").join(known, "__doc")
    return seen.select("url", tokens(F.col("url")).alias("tokens"), "bad")


def items(seen: DataFrame, n: int, support: float) -> tuple[dict[str, int], list[frozenset[str]]]:
    """(item of each frequent token, tokens of each item); the rarest items have the highest numbers."""
    here = F.xxhash64("url")  # equal urls have equal tokens, so a token's urls are known by sums of these
    one = seen.select(F.explode("tokens").alias("token"), "bad", here.alias("h"))
    found = one.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 20)).alias("s")).where(F.col("n") >= support * n).collect()
    together: dict[tuple, set[str]] = {}
    for r in found:
        together.setdefault((r["n"], r["bad"], r["x"], r["s"]), set()).add(r["token"])
    groups = sorted(together.items(), key=lambda g: (-g[0][0], sorted(g[1])))
    return {t: i for i, (_, g) in enumerate(groups) for t in g}, [frozenset(g) for _, g in groups]


def grow(base: dict[tuple[int, ...], list[int]], suffix: tuple[int, ...], total: tuple[int, int], least: int):
    """FP-growth from a conditional base (items in front of the suffix, with their numbers of bad and good URLs): yields (set, bad,
    good) of the suffix and of all its frequent extensions that a kept rule may have."""
    yield suffix, *total
    if not all(total):
        return
    count: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for own, (bad, good) in base.items():
        for i in own:
            count[i][0] += bad
            count[i][1] += good
    some = {i: c for i, c in count.items() if max(c) >= least and sum(c) < sum(total)}
    for i, c in some.items():
        ahead: dict[tuple[int, ...], list[int]] = defaultdict(lambda: [0, 0])
        for own, (bad, good) in base.items():
            if i in own:
                k = ahead[tuple(j for j in own if j < i and j in some)]
                k[0] += bad
                k[1] += good
        yield from grow(ahead, (*suffix, i), tuple(c), least)


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[Rule]:
    """Rules for bad and good URLs, surest first."""
    seen = stage(labelled(pages, labels), "labelled")
    n, n_bad = seen.agg(F.count("*"), F.count_if("bad")).first()
    if not n:
        return []
    item, groups = items(seen, n, support)
    least = max(1, math.ceil(support * n))

    def baskets(batches):
        for b in batches:
            out = [sorted({item[t] for t in found if t in item}) for found in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column("bad")], names=["items", "bad"])

    def sets(key, rows):
        base: dict[tuple[int, ...], list[int]] = {}
        for own, bad, good in zip(*(rows.column(c).to_pylist() for c in ("ahead", "bad", "good")), strict=True):
            base[tuple(own)] = [bad, good]
        total = tuple(sum(c[k] for c in base.values()) for k in (0, 1))
        own = []
        for found, bad, good in grow(base, (key[0].as_py(),), total, least) if max(total) >= least else ():
            for verdict, hit, share in (("block", bad, n_bad / n), ("allow", good, 1 - n_bad / n)):
                of = bad + good
                if hit >= least and hit / of >= confidence and lower_bound(hit / of, of) >= SURE:
                    own.append((list(found), verdict, hit / of, hit / n, hit / of / share))
        return _table(own)

    # equal URLs count as one, and so do equal conditional bases
    one = seen.select("tokens", "bad").mapInArrow(baskets, "items array<int>, bad boolean").groupBy("items").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    each = one.select(F.posexplode("items").alias("at", "item"), "items", "bad", "good").select("item", F.slice("items", F.lit(1), F.col("at")).alias("ahead"), "bad", "good")
    dealt = each.groupBy("item", "ahead").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = dealt.groupBy("item").applyInArrow(sets, "items array<int>, verdict string, confidence double, support double, lift double")
    rules = [Rule(frozenset(t for i in r["items"] for t in groups[i]), r["confidence"], r["support"], r["verdict"], r["lift"]) for r in found.collect()]
    return prune(rules)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (("items", pa.list_(pa.int32())), ("verdict", pa.string()), ("confidence", pa.float64()), ("support", pa.float64()), ("lift", pa.float64()))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])


def lower_bound(share: float, n: float) -> float:
    """Wilson's lower bound of a share seen in n cases."""
    z = ERRORS * ERRORS / n
    return (share + z / 2 - math.sqrt(z * (share * (1 - share) + z / 4))) / (1 + z)


def prune(rules: list[Rule]) -> list[Rule]:
    """Leaves out rules for which one of the same verdict on fewer tokens is at least as sure. The surest come first, blocks before allows."""
    best: dict[tuple[str, frozenset[str]], Rule] = {(r.verdict, r.tokens): r for r in rules}
    kept = []
    for r in best.values():
        less = [best.get((r.verdict, r.tokens - {t})) for t in r.tokens]
        if r.tokens and not any(k and k.confidence >= r.confidence for k in less):
            kept.append(r)
    by: dict[str, list[Rule]] = {}
    for r in kept:  # subsets that differ by more than one token, by the token they share
        by.setdefault(min(r.tokens), []).append(r)
    over = lambda r: any(k.verdict == r.verdict and k.tokens < r.tokens and k.confidence >= r.confidence for t in r.tokens for k in by.get(t, ()))
    return sorted((r for r in kept if not over(r)), key=lambda r: (-r.confidence, r.verdict != "block", -r.support, sorted(r.tokens)))


class Index:
    """Inverted index of rules: each is listed under the token that the fewest rules have."""

    def __init__(self, rules: list[Rule]):
        self.rules, uses = rules, Counter(t for r in rules for t in r[0])
        self.by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by.setdefault(min(r[0], key=lambda t: (uses[t], t)), []).append(i)

    def match(self, found: list[str]) -> int | None:
        """The surest rule all of whose tokens are there."""
        own = set(found)
        hits = [i for t in found for i in self.by.get(t, ()) if self.rules[i][0] <= own]
        return min(hits, default=None)


def judge(pages: DataFrame, fixed: list[tuple[str, str, str]], mined: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule. fixed: (verdict, host, path)."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(fixed, key=lambda r: (len(r[1] + r[2]), r)):  # the longest comes last and so is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(tokens(F.col("url")), F.array().cast("array<string>")).alias("tokens"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), "tokens")
    index = Index(mined)

    def run(batches):
        for b in batches:
            hits = [index.match(t) for t in b.column("tokens").to_pylist()]
            own = ["allow" if i is None else index.rules[i].verdict for i in hits]
            first = b.column("fixed").to_pylist()
            text = [None if i is None else " ".join(sorted(index.rules[i][0])) for i in hits]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array([f or o for f, o in zip(first, own, strict=True)], pa.string()), pa.array(text, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "mined_rule"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, mined_rule string")


