"""URL filters: a rule table, then logistic regression on hashed character
n-grams of host and path.

The rules and the split into host and path are SQL expressions. Rows that no
rule fits are judged by the model, which is fitted on the driver from the small
labelled table that ``labelled`` makes (the whole table, no sampling) and sent to
the executors as one fixed-size vector of weights.

A null url, or one without ``://``, has an empty host and path; no rule fits
it, and as it gives the model nothing to judge it is allowed. Repeated rows are
judged alike, and urls of any length whole. An empty table gives no rows. Only the
two named columns are read.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rule table.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

# The labelled table is made by rule from the words below. They are common words of
# unwanted and of ordinary sites, and syllables; no host of any given table stands among them.
BLOCK_WORDS = (
    "casino poker slots jackpot roulette betting wager gamble bingo lottery pills pharma pharmacy viagra cialis meds steroid adult porn xxx sex cams escort nude hookup "
    "warez crack keygen torrent serial cheats replica fakes rolex payday loans debt cash crypto coins profit spam linkfarm backlinks seo traffic clicks ads advert adserver popup tracker pixel affiliate banner prize winner win giveaway freebies"
).split()
BLOCK_ADDS = "free cheap best hot top buy fast easy super mega vip online now pro max live hub zone shop store deals 4u 24 777".split()
ALLOW_WORDS = (
    "library university college school museum gallery theatre weather news gazette journal herald recipes kitchen garden farm bakery hotel travel airport railway harbour "
    "hospital clinic health doctor science physics biology history archive council parliament ministry court police city village county market store books music radio cinema "
    "football tennis cycling hiking camera software docs forum wiki blog photos design studio bank insurance energy water forest bridge river mountain freedom orchestra harvest"
).split()
ALLOW_ADDS = "the my our north south east west city county national open public modern old new green blue daily weekly local".split()
SYLLABLES = "al an ar ba be ber ca con da de del den di do el en er es fa fe for ga gen ha he hi il in is it ka la le lin lo ma me men mi mo na ne ner no on or pa per ra re ri ro sa se ser so st ste ta te ter th ti tion to tra un ur us ve ver wa we wi".split()
BLOCK_LEAVES = "click?id= go/ out/ promo/ bonus/ signup/ track/ win/ offer/ deal/".split()
ALLOW_LEAVES = "article/ about/ guide/ story/ history/ topic/ chapter/ report/ page/ lesson/".split()
LABELLED_HOSTS = 1400


def labelled(hosts: int = LABELLED_HOSTS, seed: int = 5) -> tuple[tuple[str, str, int], ...]:
    """Host, path, label (1 = block); ``hosts`` of each class, one url each. Names
    vary in form within each class; languages, numbers and subdomains carry no
    label, while some paths do."""
    rng = random.Random(seed)
    pick = rng.choice

    def name(words: list[str], adds: list[str]) -> str:
        word, add, other = pick(words), pick(adds), pick(words)
        return pick([word, word, f"{word}-{add}", f"{add}-{word}", f"{word}{add}", f"{add}{word}", f"{word}-{other}", f"{word}{rng.randint(1, 99)}"])

    def url(host: str, leaves: list[str], label: int) -> tuple[str, str, int]:
        sub, top = pick(["", "", "www.", "m.", "blog."]), pick(["com", "net", "org"])
        number = str(rng.randrange(10 ** rng.randint(1, 5)))
        leaf = pick([number, number, number + ".html", number + "/", pick(leaves).split("?")[0] + number])
        return f"{sub}{host}.{pick(['example.', '', ''])}{top}", f"/{pick(['en', 'de', 'fr', 'es'])}/{leaf}", label

    out = []
    for _ in range(hosts):
        out.append(url(name(BLOCK_WORDS, BLOCK_ADDS), BLOCK_LEAVES, 1))
        made = "".join(pick(SYLLABLES) for _ in range(rng.randint(2, 5)))
        out.append(url(made if rng.random() < 0.5 else name(ALLOW_WORDS, ALLOW_ADDS), ALLOW_LEAVES, 0))
    return tuple(out)


DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)


def grams(text: str, field: str) -> np.ndarray:
    """Hashed places of the character n-grams of a host or a path. Digits are
    one class, so page numbers carry no weight."""
    text = "^" + "".join("0" if c.isdigit() else c for c in text.lower()) + "$"
    found = {text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1)}
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{field}:{g}") % DIMENSIONS for g in sorted(found)), np.int64, len(found))


def features(host: str, path: str) -> list[tuple[np.ndarray, float]]:
    out = []
    for text, field in ((host, "h"), (path, "p")):
        if text:
            places = grams(text, field)
            out.append((places, 1.0 / np.sqrt(max(1, len(places)))))
    return out


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def part(self, text: str, field: str) -> float:
        if not text:
            return 0.0
        places = grams(text, field)
        return float(self.weights[places].sum() / np.sqrt(max(1, len(places))))

    def score(self, host: str, path: str) -> float:
        """Log-odds of block; 0 where there is nothing to judge."""
        return self.bias + self.part(host, "h") + self.part(path, "p") if host or path else 0.0


@functools.cache
def fit(table: tuple[tuple[str, str, int], ...] | None = None, rounds: int = 400, rate: float = 1.0, decay: float = 1e-4) -> UrlModel:
    """Logistic regression by full-batch gradient steps: the same weights on
    every run."""
    table = labelled() if table is None else table
    x = np.zeros((len(table), DIMENSIONS), np.float32)
    for i, (host, path, _) in enumerate(table):
        for places, value in features(host, path):
            np.add.at(x[i], places, value)
    y = np.array([label for *_, label in table], np.float32)
    used = np.flatnonzero(x.any(axis=0))
    x, w, b = x[:, used], np.zeros(len(used), np.float32), 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(x @ w + np.float32(b)))) - y) * share
        w -= np.float32(rate * 20) * (x.T @ error) + np.float32(rate * decay) * w
        b -= rate * 0.2 * float(error.sum())
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return UrlModel(weights, float(b))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    host = F.regexp_extract(F.substring(url, place + 3, F.length(url)), r"(?s)^([^/?#]*)", 1)
    return F.when(place > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    path = F.regexp_extract(F.substring(url, place + 3, F.length(url)), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(place > 0, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, model: UrlModel | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, also where a rule decides)."""
    model = model or fit()
    value = F.col(url)
    split = pages.select(F.col(page_id).alias("page_id"), host_of(value).alias("host"), path_of(value).alias("path"))
    name, decided = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", name).withColumn("verdict", decided)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, float] = {}
        for batch in batches:
            scores, verdicts = [], []
            for host, path, verdict in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                if (h := hosts.get(host)) is None:
                    if len(hosts) >= 100_000:
                        hosts.clear()
                    h = hosts[host] = model.part(host, "h")
                score = model.bias + h + model.part(path, "p") if host or path else 0.0
                scores.append(score)
                verdicts.append(verdict or ("block" if score > 0 else "allow"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = split.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
