"""Languages of documents and of their stretches, by a recurrent network over bytes."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import by_value
from ..session import spread
from . import bigru
from .prose import mask, sentences

LANGS = ["en", "de", "fr", "es", "it", "nl", "pt"]

# Other spellings of the languages.
NAMES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german", "deutsch"],
    "fr": ["fra", "fre", "french", "francais", "français"],
    "es": ["spa", "spanish", "espanol", "español", "castilian"],
    "it": ["ita", "italian", "italiano"],
    "nl": ["nld", "dut", "dutch", "nederlands", "flemish"],
    "pt": ["por", "portuguese", "portugues", "português"],
}
_WORD = re.compile(r"[^\W\d_]+")
SEGMENTS = "doc_id long, named string, langs array<string>, main string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def named_language(col: Column) -> Column:
    """The language a label names, by code of two or three letters, region ignored, or by name; null if it names none of the seven."""
    c = F.lower(F.trim(col))
    head = F.split(c, "[-_]")[0]
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(head.isin(lang, *names) | c.isin(names), lang).otherwise(out)
    return out


def _plain(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch))


def _noisy(s: str, rng: np.random.Generator) -> str:
    """The changes that texts in the wild undergo: lost accents, case, typing errors."""
    if rng.random() < 0.2:
        s = _plain(s)
    r = rng.random()
    s = s.lower() if r < 0.15 else s.upper() if r < 0.27 else s
    for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.35 else 0):
        if len(s) > 6:
            k = int(rng.integers(1, len(s) - 2))
            s = s[:k] + s[k + 1] + s[k] + s[k + 2 :] if rng.random() < 0.6 else s[:k] + s[k + 1 :]
    return s


def _batches(pools: list[tuple[float, list[tuple[int, str]]]], steps: int, width: int, batch: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows over runs of sentences, mostly of one language and at times of changing ones; a class per byte, -1 at padding.

    A sentence's language is drawn first, then its pool by weight, then the sentence."""
    by = [[(w, [t for k, t in pool if k == lang]) for w, pool in pools] for lang in range(len(LANGS))]
    by = [[(w, b) for w, b in row if b] for row in by]
    share = [np.cumsum([w for w, _ in row]) / max(1e-9, sum(w for w, _ in row)) for row in by]
    there = [k for k, row in enumerate(by) if row]

    def draw(k: int) -> str:
        pool = by[k][int(np.searchsorted(share[k], rng.random(), side="right"))][1]
        return pool[int(rng.integers(len(pool)))]

    out = []
    for _ in range(steps):
        x, y = np.full((batch, width), 32, np.uint8), np.full((batch, width), -1, np.int64)
        for i in range(batch):
            k, at = int(rng.choice(there)), 0
            if rng.random() < 0.3:
                at = int(rng.integers(0, width // 2))
            while at < width:
                raw = _noisy(draw(k), rng).encode()
                cut = int(rng.integers(0, len(raw) // 2 + 1)) if at == 0 and rng.random() < 0.5 else 0
                raw = raw[cut : cut + width - at]
                x[i, at : at + len(raw)] = np.frombuffer(raw, np.uint8)
                y[i, at : at + len(raw)] = k
                at += len(raw) + 1
                if rng.random() < 0.25:
                    k = int(rng.choice(there))
                if rng.random() < 0.2:
                    break
        out.append((np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)))
    return out


def _member(base: list[tuple[int, str]], labelled: list[tuple[int, str, list[tuple[int, int]]]], seed: int, hidden: int, steps: int, width: int, batch: int) -> bigru.Weights:
    """One network, trained in up to three stages: on the trusted sentences; with those of labelled documents, but for documents of several sentences
    that the first stage holds for another language as a whole; at last without single sentences that the second stage, which by
    then knows the documents' wordings, holds for another language."""
    rng = np.random.default_rng(seed)
    p = bigru.init(hidden, len(LANGS), seed)
    first = steps // 6 if labelled else steps
    p, _ = bigru.train(p, _batches([(1.0, base)], first, width, batch, rng), last=0.3 if labelled else 0.1)
    if not labelled:
        return p
    rest = (steps - first) // 2
    texts, spans = [t for _, t, _ in labelled], [s for _, _, s in labelled]
    for stage in range(2):
        short, long = [], []
        for (k, t, sp), q in zip(labelled, texts and score([p], texts, spans)):
            size = np.array([_letters(t[a:b]) for a, b in sp], float)
            whole = (q * size[:, None]).sum(0)
            wrong = len(sp) > 2 and whole[k] < whole.max()
            for (a, b), n, one in zip(sp, size, q):
                alien = np.delete(one, k).max() > 0.8 if stage else wrong
                if not alien and n >= 8:
                    (long if len(sp) > 2 else short).append((k, t[a:b]))  # as often as it occurs
        p, _ = bigru.train(p, _batches([(0.2, base), (0.35, sorted(short)), (0.45, sorted(long))], rest, width, batch, rng), rate=0.01 if stage == 0 else 0.006, last=0.3 if stage == 0 else 0.05)
    return p


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], *, hidden: int = 32, steps: int = 600, width: int = 112, batch: int = 64, seed: int = 3) -> bigru.Weights:
    """Weights of one network. `samples` (lang, text) are trusted; of `labelled` documents a part may be wrong or mixed, see _member."""
    base = [(LANGS.index(a), mask(t)) for a, t in samples if a in LANGS and t]
    docs = [(LANGS.index(a), m, sentences(m)) for a, t in labelled if a in LANGS and t for m in [mask(t)]]
    return _member(base, docs, seed, hidden, steps, width, batch)


def _letters(s: str) -> int:
    return sum(map(str.isalpha, s))


def score(members: list[bigru.Weights], texts: list[str], spans: list[list[tuple[int, int]]], width: int = 192, margin: int = 24, cells: int = 40_000, known: dict[bytes, np.ndarray] | None = None) -> list[np.ndarray]:
    """Probabilities (sentence, language) of each text: the mean over the positions of the sentence's letters, and of the members' logarithms.

    Each sentence is read by itself, so that a neighbour in another language can't colour it, and whole: long ones in windows of `width`
    bytes with `margin` bytes of context to either side. Sentences that occur several times, or that `known` holds, are read once. Windows of all
    texts are batched together by length, up to `cells` bytes at once."""
    step = width - 2 * margin
    known = {} if known is None else known
    keys = [[re.sub(r"\s+", " ", t[a:b]).strip().encode("utf-8", "replace") for a, b in sp] for t, sp in zip(texts, spans)]
    fresh = [s for s in dict.fromkeys(s for row in keys for s in row) if s not in known]
    strings = [np.frombuffer(s, np.uint8) for s in fresh]
    where = [(j, a) for j, s in enumerate(strings) for a in range(0, len(s) if len(s) > width else 1, step)]
    end = lambda j, a: len(strings[j]) if len(strings[j]) <= width else min(len(strings[j]), a + step)
    lo = [max(0, a - margin) for _, a in where]
    hi = [min(len(strings[j]), end(j, a) + margin) for j, a in where]
    order = sorted(range(len(where)), key=lambda w: hi[w] - lo[w])
    sums = np.zeros((len(members), len(strings), len(LANGS)))
    c = 0
    while c < len(order):
        n = max(8, hi[order[c]] - lo[order[c]])
        d = c
        while d < len(order) and (d - c + 1) * max(n, hi[order[d]] - lo[order[d]]) <= max(cells, width) and d - c < 512:
            n = max(n, hi[order[d]] - lo[order[d]])
            d += 1
        part = order[c:d]
        x = np.full((n, d - c), 32, np.uint8)
        on = np.zeros((n, d - c), np.float32)
        for col, w in enumerate(part):
            j, a = where[w]
            s = strings[j][lo[w] : hi[w]]
            x[: len(s), col] = s
            letters = (s >= 65) & ((s < 91) | (s > 96)) & (s != 123) & (s != 125)
            on[a - lo[w] : end(j, a) - lo[w], col] = letters[a - lo[w] : end(j, a) - lo[w]]
        for m, p in enumerate(members):
            got = np.einsum("tbk,tb->bk", bigru.probabilities(p, x), on)
            np.add.at(sums[m], [where[w][0] for w in part], got)
        c = d
    mean = sums / np.maximum(sums.sum(-1, keepdims=True), 1e-9)
    both = np.exp(np.log(mean + 1e-4).mean(0))
    known.update(zip(fresh, both / both.sum(-1, keepdims=True)))
    return [np.array([known[s] for s in row]).reshape(-1, len(LANGS)) for row in keys]


def judge(
    text: str,
    spans: list[tuple[int, int]],
    probs: np.ndarray,
    *,
    sure: float,
    words: int,
    letters: int,
    named: str | None = None,
    doubt: float = 0.08,
    known: dict[str, tuple[int, int]] | None = None,
) -> tuple[list[str], str | None, float, list[tuple]]:
    """(languages, main one, its confidence, segments). The main language has the most letters by pooled probability. Another counts
    if a whole sentence of at least `words` words and `letters` letters is in it with probability `sure`, and, where the document's label `named` is another
    language, that one has less than `doubt`: most labels are right, so that a sentence needs odds of sure to doubt against its label. Shorter or less
    certain ones get the likeliest of the languages so found. `known` keeps the letters and words of sentences seen before."""
    if not len(spans):
        return [], None, 0.0, []
    known = {} if known is None else known
    counts = []
    for a, b in spans:
        s = text[a:b]
        if s not in known:
            known[s] = (_letters(s), len(_WORD.findall(s)))
        counts.append(known[s])
    size, count = np.array(counts, float).T
    pooled = size @ probs
    main = int(pooled.argmax())
    best = probs.argmax(1)
    clear = (probs.max(1) >= sure) & (count >= words) & (size >= letters)
    if named in LANGS:
        k = LANGS.index(named)
        clear &= (best == k) | (probs[:, k] < doubt)
    some = np.array([main])
    if clear.any():
        some = np.unique(best[clear])
        main = int(np.bincount(best[clear], weights=size[clear], minlength=len(LANGS)).argmax())
    lang = np.where(clear, best, some[probs[:, some].argmax(1)])
    change = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]])
    weight = np.add.reduceat(size, change)
    mean = np.add.reduceat(probs[np.arange(len(lang)), lang] * size, change) / np.maximum(weight, 1e-9)
    stop = np.r_[change[1:], len(lang)] - 1
    out = [(spans[i][0], spans[j][1], LANGS[lang[i]], round(float(q), 4)) for i, j, q in zip(change, stop, mean)]
    langs = [LANGS[main]] + sorted({LANGS[k] for k in set(lang.tolist())} - {LANGS[main]})
    return langs, LANGS[main], round(float(pooled[main] / max(1e-9, pooled.sum())), 4), out


def _labeller(weights, sure: float, words: int, letters: int, memory: int = 200_000):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members = weights.value
        read: dict[bytes, np.ndarray] = {}
        counted: dict[str, tuple[int, int]] = {}
        for f in frames:
            for a in range(0, len(f), 1000):
                g = f.iloc[a : a + 1000]
                texts = [mask(t) if t else "" for t in g["text"]]
                spans = [sentences(t) for t in texts]
                probs = score(members, texts, spans, known=read)
                got = [judge(t, s, q, sure=sure, words=words, letters=letters, named=c, known=counted) for t, s, q, c in zip(texts, spans, probs, g["named"])]
                yield pd.DataFrame({
                    "doc_id": g["doc_id"], "named": g["named"], "langs": [x[0] for x in got], "main": [x[1] for x in got], "confidence": [x[2] for x in got],
                    "segments": [[{"start": s, "end": e, "lang": c, "confidence": q} for s, e, c, q in x[3]] for x in got],
                })
                if len(read) > memory:  # what a task remembers of sentences is bounded; results don't depend on it
                    read.clear()
                    counted.clear()

    return run


def _trainer(options: dict):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trusted", "lang", "id"], ascending=[False, True, True])
        pairs = lambda g: list(zip(g["lang"], g["text"]))
        member = int(f["member"].iloc[0])
        p = fit(pairs(f[f["trusted"]]), pairs(f[~f["trusted"]]), **{**options, "seed": options.get("seed", 3) + 101 * member})
        return pd.DataFrame({"member": [member], "weights": [pickle.dumps(p)]})

    return run


def train_networks(docs: DataFrame, samples: DataFrame, *, members: int = 3, documents: int = 4000, **options) -> list[bigru.Weights]:
    """Weights of `members` networks, whose mean decides, so that a sentence that one of them misread in training stays right.

    Each trains on all samples and on its own at most `documents` labelled documents (the bound), picked evenly over languages, half of them
    one-liners of up to 80 characters, whose wordings differ from longer texts', by a hash of doc_id and member. Each is one
    task with one thread for its linear algebra; only the weights (under 300 kB each) come to the driver."""
    known = docs.select(F.col("doc_id").alias("id"), "text", named_language(F.col("lang")).alias("lang")).filter("lang is not null and length(text) between 20 and 1500")
    each = max(1, documents // (2 * len(LANGS)))
    everyone = F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member")
    picked = samples.select(F.col("sample_id").cast("long").alias("id"), "text", "lang", F.lit(True).alias("trusted"), everyone)
    known = known.withColumn("short", F.length("text") <= 80)
    # the counts give a bound on the hash below which each group's first rows lie, so that only a few rows are sorted
    share = F.lit(0.0)
    for r in known.groupBy("lang", "short").count().collect():
        share = F.when((F.col("lang") == r["lang"]) & (F.col("short") == r["short"]), min(1.0, 4 * each / r["count"])).otherwise(share)
    known = known.withColumn("share", share).select("*", everyone).withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "member"), 2))
    w = Window.partitionBy("member", "lang", "short").orderBy("h", "id", "text")
    part = known.filter(F.col("h") <= F.col("share") * 2.0**62).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each)
    picked = picked.unionByName(part.select("id", "text", "lang", F.lit(False).alias("trusted"), "member"))
    got = picked.repartitionById(members, F.col("member")).groupBy("member").applyInPandas(_trainer(options), "member int, weights binary").collect()
    if not got:
        raise ValueError("no samples to train on")
    return [pickle.loads(r["weights"]) for r in sorted(got, key=lambda r: r["member"])]


def label_languages(docs: DataFrame, weights: list[bigru.Weights], *, carry: Column | None = None, sure: float = 0.75, words: int = 4, letters: int = 16) -> DataFrame:
    """(doc_id, named, langs, main, confidence, segments) of each document's whole text; named is the column `carry` or null.

    langs: main language first; empty (main null, confidence 0) if the text is null, empty or holds no prose. segments are stretches of
    one language as places in the text. One row per row given; the weights (under 1 MB) are broadcast. Rows stay where the scan
    put them, unless it has fewer tasks than there are cores."""
    w = docs.sparkSession.sparkContext.broadcast(weights)
    named = F.lit(None).cast("string") if carry is None else carry
    return spread(docs.select("doc_id", "text", named.alias("named"))).mapInPandas(_labeller(w, sure, words, letters), SEGMENTS)


by_value(__name__)
