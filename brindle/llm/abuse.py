"""Abusive, hateful or sexual content, by cumulative-link ordinal regression on sparse features of sentences.

A sentence has a grade of severity per category: 0 nothing, 1 a listed word in another sense, 2 the content itself.
One weight per feature is shared by both thresholds: ``P(grade >= k) = s(w x - b_k)``, ``b_1 <= b_2``; the expected
severity is the sum of both probabilities. A document's score is that of its worst sentence.

Reviewers labelled documents, not sentences, and erred at times. So the fit first guesses the sentence that a label
means (the one whose words are most enriched in the category against the corpus), fits, guesses again with the fitted
model, and at last takes clear cases from unlabelled texts in. What is common in the corpus, as words and as features,
is counted in Spark over all documents; only the sentences of the fit come from a bounded number of them. Words are read through their disguises: look-alike
letters, digits for letters, spaced or dotted letters, masked, doubled and dropped letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.mixing import source_key
from brindle.llm.sampling import least_draws
from brindle.session import cut_lineage, written

CATEGORIES = ("abusive", "hateful", "sexual")
#: The fit looks at no more labelled and unlabelled documents than these.
LABELLED, UNLABELLED = 20_000, 6_000
#: Characters of the longest document that the fit takes sentences from (all are counted and scored), and terms at most.
LONGEST, MOST_TERMS = 50_000, 100_000
BITS = 18

#: Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("авеіјкмнорсѕтухԁԛԝαεικνορτυχ", "abeijkmhopcstyxdqwaeiknoptux")
#: Signs written for letters.
_LEET = str.maketrans("013457@$!", "oieastasi")
_ANY_ALIKE = re.compile(f"[{''.join(map(chr, _ALIKE))}]+")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_SPACED = re.compile(r"(?<![\w.])\w(?:[ ._*-]\w(?!\w)){2,}|(?<![\w.])(?:\w[._*-]){2,}\w+")
#: What every match of ``_SPACED`` contains, and few texts do.
_MAYBE_SPACED = re.compile(r"[ ._*-]\w(?:[ ._*-]\w(?!\w)|[._*-]\w)")
_WORD = re.compile(r"[^\W\d_](?:[\w'’*@$#!-]*[\w*])?|\d[\w@$!]*[^\W\d_][\w@$!]*|[一-鿿]")
_SENTENCE_END = re.compile(r"[.!?](?=\s|[一-鿿])|[。！？\n]")
_SPEAKER = re.compile(r"\s*(?:user|assistant|system|subject)\s*:\s*", re.I)



def plain_text(text: str) -> str:
    """Lower case, compatible forms, Latin letters for look-alikes, hidden signs gone, spaced letters joined."""
    if text.isascii():
        text = text.lower()
    else:
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).lower())
        text = _ANY_ALIKE.sub(lambda m: m.group().translate(_ALIKE), text)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m.group()), text)
    return text


def _single(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


class Reader:
    """Sentences of a text as hashed sparse features."""

    def __init__(self, lexicon: set[str], common: set[str]):
        self.common = common
        self.lexicon = {w for w in lexicon if len(w) > 2}
        self.singles = {_single(w): w for w in sorted(self.lexicon)}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.lexicon):
            self.by_length.setdefault(len(w), []).append(w)
        self.dropped = {w[:k] + w[k + 1 :]: w for w in sorted(self.lexicon) if len(w) > 4 for k in range(1, len(w))}
        self.known: dict[str, str] = {}
        self.hashes = _Hashes(self)

    def _undisguised(self, w: str) -> str:
        if w in self.common or w in self.lexicon:
            return w
        bare = w.strip("'’-!")
        if bare in self.common or bare in self.lexicon:
            return bare
        letters = bare.translate(_LEET) if re.search(r"[\d@$!]", bare) else bare
        if letters in self.lexicon:
            return letters
        if re.search(r"[*_#@$-]", bare):
            if "-" in bare and all(p in self.common for p in bare.split("-")):
                return bare
            for candidate in (bare.translate(_LEET), bare):
                shape = re.compile(re.sub(r"[*_#@$-]", ".", re.escape(candidate).replace("\\*", "*").replace("\\-", "-").replace("\\#", "#")) + "$")
                for n in (len(candidate), len(candidate) + 1, len(candidate) - 1):
                    for known in self.by_length.get(n, ()) if n == len(candidate) else ():
                        if shape.match(known):
                            return known
            if "*" in bare:
                return "<masked>"
        if (known := self.singles.get(_single(letters))) and len(letters) > len(known):
            return known
        return self.dropped.get(letters, letters)

    def _spans(self, text: str) -> Iterator[list[str]]:
        """The words of each sentence, as they are written."""
        at, text = 0, plain_text(text)
        for end in [*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]:
            speaker = _SPEAKER.match(text, at, end)
            if words := _WORD.findall(text, speaker.end() if speaker else at, end):
                yield words
            at = end

    def word(self, w: str) -> str:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[w] = self._undisguised(w)
        return got

    def words(self, text: str) -> list[str]:
        return [self.word(w) for w in _WORD.findall(text)]

    def sentences(self, text: str) -> list[list[str]]:
        return [[self.word(w) for w in words] for words in self._spans(text)]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words in order, the number of words of each sentence, and the number of sentences of each text."""
        flat, lengths, counts = [], [], []
        for text in texts:
            n = len(lengths)
            for words in self._spans(text) if text else ():
                flat.extend(map(self.hashes.__getitem__, words))
                lengths.append(len(words))
            counts.append(len(lengths) - n)
        return np.array(flat, np.uint32), np.array(lengths, np.int64), np.array(counts, np.int64)


def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF


class _Hashes(dict):
    """32-bit hashes of words behind their disguise, kept up to a bound."""

    def __init__(self, reader: Reader):
        self.reader = reader

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = word_hash(self.reader.word(w))
        return h

    def __reduce__(self):  # sent empty
        return _Hashes, (self.reader,)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats (a hash table, as ``np.unique`` takes for numbers, is far slower on many)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) of the distinct words and word pairs of each sentence, in order of sentences."""
    h = words.astype(np.uint64)
    first = np.zeros(len(h), bool)
    first[np.cumsum(lengths) - lengths] = True
    before = np.where(first, np.uint64(1), np.concatenate([[np.uint64(0)], h])[:-1])
    with np.errstate(over="ignore"):
        single = h * np.uint64(0x9E3779B97F4A7C15)
        pair = (before * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h + np.uint64(0x165667B19E3779F9))) * np.uint64(0x9E3779B97F4A7C15)
    f = np.concatenate([single, pair]) >> np.uint64(64 - BITS)
    owner = np.tile(np.repeat(np.arange(len(lengths)), lengths), 2)
    both = _distinct(owner << BITS | f.astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


class Rows:
    """Sentences as distinct feature numbers: ``flat[ends[n - 1]:ends[n]]`` are those of sentence ``n``."""

    def __init__(self, owner: np.ndarray, flat: np.ndarray, n: int):
        self.owner, self.flat, self.n = owner, flat, n
        self.ends = np.cumsum(np.bincount(owner, minlength=n))

    @classmethod
    def of(cls, lists: list[list[int]]) -> Rows:
        return cls(np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64), np.array([f for x in lists for f in x], np.int64), len(lists))

    def __getitem__(self, n: int) -> np.ndarray:
        return self.flat[self.ends[n - 1] if n else 0 : self.ends[n]]

    def take(self, used: np.ndarray) -> Rows:
        """The sentences ``used`` (in order), numbered afresh."""
        place = np.full(self.n, -1)
        place[used] = np.arange(len(used))
        keep = place[self.owner] >= 0
        return Rows(place[self.owner[keep]], self.flat[keep], len(used))


class Ordinal:
    """Proportional odds with two thresholds on rows of feature numbers."""

    def __init__(self, weights: np.ndarray | None = None, bounds: tuple[float, float] = (2.0, 4.0)):
        self.w = np.zeros(1 << BITS) if weights is None else weights
        self.b = np.array(bounds, float)

    def at_least(self, rows: Rows) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) of each row."""
        z = np.bincount(rows.owner, self.w[rows.flat], rows.n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.b, -30, 30)))

    def centre(self, cut: float) -> None:
        """Moves the upper threshold so that a probability of ``cut`` becomes one half; the lower one stays below it."""
        self.b[1] += np.log(cut / (1 - cut))
        self.b[0] = min(self.b[0], self.b[1] - 0.1)

    def fit(self, rows: Rows, grade: np.ndarray, weight: np.ndarray, least: int = 1, rounds: int = 60, rate: float = 0.3, penalty: float = 0.004) -> Ordinal:
        """Adaptive gradient steps on the weighted likelihood with a quadratic penalty.

        A feature that fewer than ``least`` rows of the highest grade have gets no weight above 0, so that no single
        row, its label perhaps an error, is learnt by heart.
        """
        flat, at = rows.flat, rows.owner
        # what only sentences of grade 0 have could but lower scores that are low
        told = np.zeros(1 << BITS, bool)
        told[flat[grade[at] > 0]] = True
        flat, at = flat[told[flat]], at[told[flat]]
        used = np.flatnonzero(np.bincount(flat, minlength=1 << BITS))
        flat = np.searchsorted(used, flat)
        w, b = self.w[used].copy(), self.b.copy()
        g2, h2 = np.full(len(w), 1e-8), np.full(2, 1e-8)
        scale = weight.sum()
        lone = np.bincount(flat, (grade == 2)[at], len(w)) < least
        for _ in range(rounds):
            z = np.bincount(at, w[flat], rows.n)
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - b, -30, 30)))
            d = p * (1 - p)
            p0, p1, p2 = 1 - p[:, 0], np.maximum(p[:, 0] - p[:, 1], 1e-9), p[:, 1]
            # gradient of the log likelihood by each linear predictor z - b_k
            e1 = np.where(grade == 0, -d[:, 0] / np.maximum(p0, 1e-9), np.where(grade == 1, d[:, 0] / p1, 0)) * weight
            e2 = np.where(grade == 2, d[:, 1] / np.maximum(p2, 1e-9), np.where(grade == 1, -d[:, 1] / p1, 0)) * weight
            gw = np.bincount(flat, (e1 + e2)[at], len(w)) - penalty * scale / 100 * w
            gb = -np.array([e1.sum(), e2.sum()])
            g2 += gw * gw
            h2 += gb * gb
            w += rate * gw / np.sqrt(g2)
            w[lone] = np.minimum(w[lone], 0)
            b += rate * gb / np.sqrt(h2)
            b[1] = max(b[1], b[0] + 0.1)
        self.w[used], self.b = w, b
        return self


def _raw_words(text: str) -> set[str]:
    return set(_WORD.findall(plain_text(text)))


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n``: in how many rows of ``text`` a word occurs as it is written. All rows are read; counts are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def counted() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_raw_words(text))
                if len(seen) > 300_000:
                    yield counted()
        yield counted()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def read_documents(documents: DataFrame, reader: Reader) -> DataFrame:
    """``doc_id, words, lengths``: each text as 32-bit hashes of its words and the lengths of its sentences, written once.

    Null and empty texts have none. Everything that follows reads these numbers instead of the texts.
    """
    sent = documents.sparkSession.sparkContext.broadcast(reader)
    rows = documents.select("doc_id", "text")
    key = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths, counts = sent.value.read(batch.column("text").to_pylist())
            at = np.cumsum(np.concatenate([[0], lengths]))[np.cumsum(np.concatenate([[0], counts]))]
            ends = np.cumsum(np.concatenate([[0], counts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([x[a:b].tobytes() for a, b in zip(e, e[1:])], pa.binary()) for x, e in ((words, at), (lengths.astype(np.uint32), ends)))], names=["doc_id", "words", "lengths"]
            )

    return written(rows.mapInArrow(read, f"doc_id {key}, words binary, lengths binary"))


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Reader.read`` gave, from a batch of ``read_documents``."""
    words, lengths = (batch.column(c).to_pylist() for c in ("words", "lengths"))
    return np.frombuffer(b"".join(words), np.uint32), np.frombuffer(b"".join(lengths), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in lengths], np.int64)


def count_features(numbered: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of ``numbered`` each feature is, and how many have any. All rows are read; the counters are of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            words, lengths, counts = _numbers(batch)
            sentence, f = features(words, lengths)
            found = _distinct(np.repeat(np.arange(len(counts)), counts)[sentence] << BITS | f)
            n[:-1] += np.bincount(found & ((1 << BITS) - 1), minlength=1 << BITS)
            n[-1] += (counts > 0).sum()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["feature", "n"])

    total = numbered.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[total.column("feature").to_numpy()] = total.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _enriched(texts: list[set[int]], background: np.ndarray, n_documents: int) -> dict[int, float]:
    """Log odds of the features of ``texts`` against all other documents."""
    a = Counter(f for t in texts for f in t)
    na, nb = len(texts) + 1, n_documents - len(texts) + 1
    return {f: np.log((n + 0.1) / na) - np.log((background[f] - n + 0.5) / nb) for f, n in a.items()}


def _best_cut(positive: np.ndarray, clean: np.ndarray) -> float:
    """Where labelled documents are told apart best (F1); the middle of equally good cuts."""
    cuts = np.arange(0.25, 0.951, 0.01)
    right, wrong = (np.array([(x >= c).sum() for c in cuts]) for x in (positive, clean))
    score = 2 * right / np.maximum(1, right + wrong + len(positive))
    best = cuts[score >= score.max() - 1e-9]
    return float((best[0] + best[-1]) / 2)


def fit_reader(texts: DataFrame, labelled: list[tuple[str, str]], terms: list[tuple[str, str]], total: int) -> Reader:
    """Reader by the words of all ``total`` ``texts``, of (text, category) rows and of (term, category) rows."""
    words = written(count_words(texts))
    # a document has so many words; so these are no more than 250 times the words of a usual one
    common = {r.word for r in words.filter(F.col("n") >= max(5, 0.004 * total)).collect()}
    listed = {w for t, _ in terms if t for w in plain_text(t).split()}
    bad = [_raw_words(t) for t, c in labelled if c in CATEGORIES]
    marked = {w: n for w, n in Counter(w for s in bad for w in s).items() if w.isalpha() and w not in common and n >= 2}
    asked = texts.sparkSession.createDataFrame([(w,) for w in sorted(marked)], "word string")
    spread = {r.word: r.n for r in words.join(F.broadcast(asked), "word").collect()}
    return Reader(listed | {w for w, n in marked.items() if n * total > 3 * spread[w] * len(bad)}, common)


def fit_severity(reader: Reader, background: np.ndarray, n_documents: int, labelled: list[tuple[str, str]], unlabelled: list[str], terms: list[tuple[str, str]], rounds: int = 4) -> dict[str, Ordinal]:
    """One model per category from (text, category) rows, plain texts and (term, category) rows.

    ``background`` tells in how many of all ``n_documents`` documents, those with a label among them, each feature is.
    """
    texts = [t for t, _ in labelled] + unlabelled
    read = [reader.sentences(t) for t in texts]
    words = [" ".join(s) for sentences in read for s in sentences]
    lengths = np.array([len(s) for sentences in read for s in sentences], np.int64)
    rows = Rows(*features(np.array([word_hash(w) for sentences in read for s in sentences for w in s], np.uint32), lengths), len(lengths))
    owner = np.repeat(np.arange(len(texts)), [len(sentences) for sentences in read])
    spans = [np.flatnonzero(owner == k) for k in range(len(labelled))]
    truth = np.array([c for _, c in labelled] + ["?"] * len(unlabelled), object)
    models = {}
    for category in CATEGORIES:
        senses = [rf"\b{re.escape(plain_text(t))}" for t, c in terms if c == category and t]
        sense = re.compile("|".join(senses)) if senses else None
        mention = np.array([sense is not None and sense.search(w) is not None for w in words], np.int64)
        positive = {k for k in range(len(labelled)) if truth[k] == category and len(spans[k])}
        if not positive:
            models[category] = Ordinal(bounds=(30.0, 31.0))
            continue
        of = truth[owner]
        unclear = (of != "none") & (of != category)
        mine = [{f for n in spans[k] for f in rows[n].tolist()} for k in sorted(positive)]
        seen = Counter(f for t in mine for f in t)
        odds = _enriched(mine, background, n_documents)
        # with enough examples, what only one of them has says nothing yet
        least = 2 if len(positive) >= 12 else 1
        odds = {f: x for f, x in odds.items() if x > 1.0 and seen[f] >= least}
        best = {}
        for k in positive:
            score = np.array([sum(sorted((odds.get(f, 0.0) for f in rows[n].tolist()), reverse=True)[:8]) + 4 * mention[n] for n in spans[k]])
            if score.max() > 2.0:
                best[k] = int(spans[k][score.argmax()])
        model = Ordinal()
        for turn in range(rounds):
            grade, weight = mention.copy(), np.zeros(rows.n)
            weight[of == "none"] = 1.0
            if turn:
                p = model.at_least(rows)[:, 1]
                weight[(of == category) & (p < 0.2)] = 0.5
                # clear cases of texts without label, of this category or not
                weight[unclear & (p < 0.1)] = 0.3
                sure = unclear & (p > 0.6)
                grade[sure], weight[sure] = 2, 2.0
                sure = (of == category) & (p > 0.6)
                grade[sure], weight[sure] = 2, 3.0
            for n in best.values():
                grade[n], weight[n] = 2, 3.0
            used = np.flatnonzero(weight)
            model = Ordinal().fit(rows.take(used), grade[used], weight[used], least)
            p = model.at_least(rows)[:, 1]
            # the sentence that a label means; none, if no sentence of the text supports it
            best = {k: int(spans[k][p[spans[k]].argmax()]) for k in positive}
            best = {k: n for k, n in best.items() if p[n] > 0.3}
        if len(positive) >= 12:
            whole = np.array([p[at].max() if len(at) else 0.0 for at in spans])
            model.centre(_best_cut(whole[truth[: len(spans)] == category], whole[truth[: len(spans)] == "none"]))
        models[category] = model
    return models


def fit_from_tables(documents: DataFrame, labels: DataFrame, terms: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[DataFrame, dict[str, Ordinal], Reader]:
    """The documents as numbers (``read_documents``), the models, and the reader.

    Words and features are counted over all documents. The sentences of the fit come from at most ``labelled`` labelled
    and ``unlabelled`` other documents, those of the smallest draws, none longer than ``LONGEST`` characters. More than
    ``MOST_TERMS`` terms are an error.
    """
    given = labels.select("doc_id", F.lower("category").alias("category")).filter("doc_id is not null and category is not null").distinct()
    texts = documents.select("doc_id", "text").filter("text is not null")
    fit_texts = texts.filter(F.length("text") <= LONGEST)
    given = cut_lineage(least_draws(given, "doc_id", given.count(), labelled))
    rows = fit_texts.join(F.broadcast(given), "doc_id").select("doc_id", "text", "category").collect()
    sure = Counter(r.doc_id for r in rows if r.category != "none")
    # a document with both a category and "none" was labelled twice; the category is what needs an example
    rows = [(r.text, r.category) for r in sorted(rows, key=lambda r: (r.doc_id, r.category)) if r.category != "none" or not sure[r.doc_id]]
    total = texts.count()
    others = least_draws(fit_texts.join(F.broadcast(given.select("doc_id").distinct()), "doc_id", "left_anti"), "doc_id", total, unlabelled)
    known = [(r.term, r.category) for r in terms.select("term", "category").distinct().limit(MOST_TERMS + 1).collect()]
    if len(known) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    reader = fit_reader(texts.select("text"), rows, known, total)
    numbered = read_documents(documents, reader)
    return numbered, fit_severity(reader, *count_features(numbered), rows, [r.text for r in others.collect()], known), reader


def score_documents(numbered: DataFrame, models: dict[str, Ordinal]) -> DataFrame:
    """``doc_id, category, p_listed, p_content, severity`` for every row of ``read_documents`` and category.

    The score is that of the worst sentence of the whole text; null and empty texts score 0. Repeated rows and null ids
    give their rows. Nothing is shuffled.
    """
    sent = numbered.sparkSession.sparkContext.broadcast(models)
    key = numbered.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            words, lengths, counts = _numbers(batch)
            x, owner, worst = Rows(*features(words, lengths), len(lengths)), np.repeat(np.arange(len(ids)), counts), []
            for category in CATEGORIES:
                top = np.zeros((len(ids), 2))
                np.maximum.at(top, owner, models[category].at_least(x))
                worst.append(top)
            take = pa.array(np.repeat(np.arange(len(ids)), len(CATEGORIES)))
            p = np.stack(worst, 1).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), pa.array(list(CATEGORIES) * len(ids), pa.string()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1))],
                names=["doc_id", "category", "p_listed", "p_content", "severity"],
            )

    return numbered.mapInArrow(score, f"doc_id {key}, category string, p_listed double, p_content double, severity double")


def rates_by_source(documents: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``source, category, n_docs, n_found, rate, mean_severity``; sources in one spelling, null ones as ``unknown``."""
    own = documents.select("doc_id", F.coalesce(source_key("source"), F.lit("unknown")).alias("source")).distinct()
    rows = scores.select("doc_id", "category", "p_content", "severity").distinct().join(own, "doc_id")
    found = F.count_if(F.col("p_content") >= threshold)
    return rows.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n_docs"), found.alias("n_found"), (found / F.count(F.lit(1))).alias("rate"), F.avg("severity").alias("mean_severity"))
