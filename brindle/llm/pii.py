"""Personal data in free text, by a semi-Markov conditional random field over candidate spans.

Broad patterns and a lexicon of names propose spans, several for one place where its boundary or type is unsure. Every
candidate is scored as a whole (its form, the words around it, how much its parts look like names), and a dynamic
programme over the text picks the set of spans that don't overlap with the highest score; words outside score 0. What
is a word is counted over all texts, in Spark. The weights are fitted here by the likelihood of whole segmentations, on
a bounded sample of texts whose certain spans are known by construction (forms that leave no doubt, names of the lexicon
that aren't words); places that are in doubt are left out of the fit and are what the fitted weights then decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.sampling import unit_draw
from brindle.session import cut_lineage

KINDS = ("email", "phone", "id_number", "address", "name")
#: Texts that the fit of the weights looks at, at most, and the characters of the longest; words are counted in all.
SAMPLE, LONGEST = 24_000, 20_000
#: Known names at most; more are an error, none is left out.
MOST_NAMES = 2_000_000

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?: ?@ ?| ?\( ?at ?\) ?| ?\[ ?at ?\] ?)"
_DOT = r"(?:\.| ?\( ?dot ?\) ?| ?\[ ?dot ?\] ?)"
_W = r"[A-ZÀ-Þ][\w'’-]*"
#: Words that streets end or begin with.
_EN = "Road|Rd|Row|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Terrace|Way|Street|St|Drive|Close|Court|Ct|Crescent|Place|Square|Hill|Walk|Gardens|Park|Mews|Parade"
_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|damm|ufer|ring|steig"
_ES = "Calle|Avenida|Avda\\.|Plaza|Paseo|Camino|Carrera|Ronda"
_FR = "rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours"

PATTERNS: list[tuple[str, str, re.Pattern]] = [
    ("email", "plain", re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![\w@])")),
    ("email", "spelt", re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)),
    ("email", "words", re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?: AT | at ){_LABEL}(?:(?: DOT | dot |\.){_LABEL})*(?: DOT | dot ){_LABEL}(?![\w@])")),
    ("phone", "plus", re.compile(r"(?<![\w+])(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,9}\)?){1,7}(?![\w])")),
    ("phone", "north", re.compile(r"(?<![\w+.-])(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])")),
    ("phone", "trunk", re.compile(r"(?<![\w+.,-])\(?0\d{1,6}\)?(?:[ /-]?\d{2,9}){1,5}(?![\w-])")),
    ("id_number", "letters", re.compile(r"(?<![\w-])[A-Z]{1,3} ?\d{6,9}[A-Z]?(?![\w-])")),
    ("id_number", "mixed", re.compile(r"(?<![\w-])[A-Z]{3,5}\d{6}[A-Z0-9]{2,5}(?![\w-])")),
    ("id_number", "pairs", re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![\w-])")),
    ("id_number", "three_two_four", re.compile(r"(?<![\w.,+/-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")),
    ("id_number", "threes", re.compile(r"(?<![\w.,+/-])\d{3}([- .])\d{3}\1\d{3}(?:-\d{2})?(?![\w-])")),
    ("address", "number_first", re.compile(rf"(?<![\w.,-])\d{{1,4}}[a-zA-Z]?,? (?:{_W} ){{1,3}}(?:{_EN})\b(?!\s[A-Z][a-z]+s\b)")),
    ("address", "compound", re.compile(rf"\b(?:[A-ZÄÖÜ][\wäöüß]+ )?[A-ZÄÖÜ][\wäöüß-]*(?:{_DE}) \d{{1,4}}(?: ?[a-z])?(?!\w)")),
    ("address", "compound_short", re.compile(rf"\b[A-ZÄÖÜ][\wäöüß-]*(?:{_DE}) \d{{1,4}}(?: ?[a-z])?(?!\w)")),
    ("address", "preposition", re.compile(r"\b(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Hinter dem|Vor dem) [A-ZÄÖÜ][\wäöüß-]+(?: [A-ZÄÖÜ][\wäöüß-]+)? \d{1,4}(?: ?[a-z])?(?!\w)")),
    ("address", "type_first", re.compile(rf"\b(?:{_ES})(?: (?:de|del|la|los|las|el|{_W})){{1,5}},? \d{{1,4}}(?: ?[a-z])?(?!\w)")),
    ("address", "number_type", re.compile(rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter|[a-z]))?,? (?:{_FR}) (?:(?:de la|de l['’]|des|du|de|d['’]|l['’]) ?)?(?:{_W})(?:[ -](?:{_W}|de|des|du|la|le))*")),
]
_EN_LOOSE = re.compile(rf"(?<![\w.,-])\d{{1,4}}[a-zA-Z]?,? (?:[\w'’-]+ ){{1,3}}(?:{_EN})\b", re.I)
_DIGIT, _MANY, _AT_WORD = re.compile(r"\d"), re.compile(r"(?:\d\D{0,6}?){6}"), re.compile(r"\bat\b", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INITIAL = re.compile(r"[^\W\d_]\.")
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "sr", "sra", "mme"}


def _pieces(word: str) -> list[str]:
    w = f"^{word.lower()}$"
    out = [f"a{w[:n]}" for n in (3, 4, 5)] + [f"z{w[-n:]}" for n in (3, 4, 5, 6)]
    return out + [w[n : n + 3] for n in range(len(w) - 2)] + [w[n : n + 4] for n in range(len(w) - 3)]


class WordSet:
    """Words as their sorted 64-bit hashes, 8 bytes each."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.hashes)

    def __contains__(self, word: str) -> bool:
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        at = int(self.hashes.searchsorted(h))
        return at < len(self.hashes) and self.hashes[at] == h


def _names_in(known: list[tuple[str, str]]) -> set[str]:
    return {name.lower() for name, kind in known if name and kind in ("given", "family")}


class NameLexicon:
    """How much a word looks like a given or a family name: log odds of its letters, against the words of the corpus."""

    def __init__(self, known: list[tuple[str, str]], words: WordSet, pieces: dict[str, int], plain: int):
        """``words`` of the corpus; ``pieces``: in how many of its ``plain`` words (not names, over 2 letters) each piece is."""
        self.known = {"given": set(), "family": set()}
        for name, kind in known:
            if name and kind in self.known:
                self.known[kind].add(name.lower())
        listed = self.known["given"] | self.known["family"]
        #: What the corpus writes in small letters more than not is a word; a known name may be one too.
        self.words = words
        self.ordinary = {w for w in listed if w in words}
        self.weights = self._fit([w for w in listed - self.ordinary if len(w) > 2], pieces, plain)
        self.seen: dict[str, float] = {}
        self.looked: dict[str, float] = {}

    @staticmethod
    def _fit(names: list[str], b: dict[str, int], words: int) -> dict[str, float]:
        a = Counter(p for n in names for p in set(_pieces(n)))
        na, nb = len(names) + 1, words + 1
        return {p: math.log((a[p] + 0.2) / na) - math.log((b.get(p, 0) + 0.2) / nb) for p in {*a, *b}}

    def odds(self, word: str) -> float:
        """Mean log odds per piece; above 0 looks like a name."""
        key = word.lower()
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            if key in self.ordinary:
                got = 0.2
            elif key in self.known["given"] or key in self.known["family"]:
                got = 3.0
            elif key in self.words:
                got = -3.0
            else:
                p = _pieces(key)
                got = sum(self.weights.get(x, -0.5) for x in p) / len(p)
            self.seen[key] = got
        return got

    def look(self, word: str) -> float:
        """The odds of a word that may be joined by a hyphen (the least of its parts) or an initial."""
        got = self.looked.get(word)
        if got is None:
            if len(self.looked) > 200_000:
                self.looked.clear()
            got = self.looked[word] = min(self.odds(p) for p in re.split("[-'’]", word) if p) if len(word) > 1 else 0.0
        return got


def _case(word: str) -> str:
    return "up" if word.isupper() and len(word) > 2 else "cap" if word[:1].isupper() else "low"


class Candidate:
    __slots__ = ("kind", "start", "end", "form", "features", "certain")

    def __init__(self, kind: str, start: int, end: int, form: str, features: list[str], certain: int):
        self.kind, self.start, self.end, self.form, self.features = kind, start, end, form, features
        #: 1 surely personal, -1 surely not, 0 in doubt
        self.certain = certain


def _around(text: str, start: int, end: int) -> list[str]:
    left = re.findall(r"[\w@]+|[^\w\s]", text[max(0, start - 40) : start].lower())[-3:]
    right = re.findall(r"[\w@]+|[^\w\s]", text[end : end + 25].lower())[:2]
    left = ["^"] * (3 - len(left)) + [re.sub(r"\d+", "0", x) for x in left]
    right = [re.sub(r"\d+", "0", x) for x in right] + ["$"] * (2 - len(right))
    return [f"l1={left[2]}", f"l2={left[1]} {left[2]}", f"l3={left[0]} {left[1]} {left[2]}", f"r1={right[0]}", f"r2={right[0]} {right[1]}"]


def _name_candidates(text: str, lexicon: NameLexicon) -> Iterator[Candidate]:
    words = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    n = len(words)
    looks = [lexicon.look(w) for _, _, w in words]
    for i in [k for k, x in enumerate(looks) if x >= -1.0]:
        start, end, word = words[i]
        initial = len(word) == 1 and word.isupper() and text[end : end + 1] == "."
        if not initial and len(word) < 2:
            continue
        if initial and start and (text[start - 1].isalnum() or text[start - 1] in ".-"):
            continue
        j, middle = i + 1, False
        gap_start = end + (1 if initial else 0)
        # a middle initial
        if j < n and not initial and len(words[j][2]) == 1 and words[j][2].isupper() and text[gap_start : words[j][0]] == " " and text[words[j][1] : words[j][1] + 1] == ".":
            gap_start, j, middle = words[j][1] + 1, j + 1, True
        if j >= n:
            continue
        s2, e2, word2 = words[j]
        gap = text[gap_start:s2]
        comma = gap == ", "
        trailing = len(word2) == 1 and word2.isupper() and text[e2 : e2 + 1] == "."
        if gap not in (" ", ", ") or (comma and (initial or middle)) or (len(word2) < 2 and not (comma and trailing)):
            continue
        if not trailing and looks[j] < -1.0 or {word.lower(), word2.lower()} & _TITLES:
            continue
        # a part that looks less like a name needs one that does beside it
        if min(looks[i], 3 if trailing else looks[j]) < -0.3 and max(-3 if initial else looks[i], -3 if trailing else looks[j]) < 0.8:
            continue
        end2 = e2 + 1 if trailing else e2
        # the second part of a name turned round may carry a middle initial
        tails = [end2]
        if comma and not trailing and (m := re.match(r" [A-Z]\.", text[end2 : end2 + 3])):
            tails.append(end2 + m.end())
        parts = [x for x, look in ((word, looks[i]), (word2, looks[j])) if len(x) > 1]
        low = min(lexicon.look(p) for p in parts)
        first, second = (word2, word) if comma else (word, word2)
        given = "i" if len(first) == 1 else "k" if first.lower() in lexicon.known["given"] else "f" if first.lower() in lexicon.known["family"] else "n"
        family = "i" if len(second) == 1 else "k" if second.lower() in lexicon.known["family"] else "g" if second.lower() in lexicon.known["given"] else "n"
        common = any(p.lower() in lexicon.ordinary for p in parts)
        cases = f"{_case(word)}{_case(word2)}"
        unlike = low < 0 and not (low > -0.5 and "low" not in cases and max(lexicon.look(p) for p in parts) > 0.8)
        sure = -1 if common and given == "f" else 0 if common else 1 if low > 0.8 and not (initial and cases == "low") else -1 if unlike else 0
        for k, tail in enumerate(tails):
            form = f"{'comma' if comma else 'plain'}{'+i' if initial or trailing else ''}{'+m' if middle or k else ''}"
            features = [f"form={form}", f"case={cases}", f"parts={given}{family}", f"low={'high' if low > 0.8 else 'less' if unlike else 'mid'}", f"common={common}", f"longer={k}"]
            yield Candidate("name", start, tail, form, features + _around(text, start, tail), sure if k == len(tails) - 1 else -1 if sure > 0 else sure)


def candidates(text: str, lexicon: NameLexicon) -> list[Candidate]:
    found: dict[tuple, Candidate] = {}
    digits_of = _DIGIT.search(text) is not None
    mail = "@" in text or _AT_WORD.search(text) is not None
    if digits_of or mail:
        many = digits_of and _MANY.search(text) is not None
        for kind, form, pattern in PATTERNS:
            if not (mail if kind == "email" else digits_of if kind == "address" else many):
                continue
            for m in pattern.finditer(text):
                start, end = m.span()
                s = m.group()
                digits = sum(c.isdigit() for c in s)
                sure = 1
                if kind == "phone":
                    if not 9 <= digits <= 15:
                        continue
                    if form == "trunk" and not 10 <= digits <= 12:
                        continue
                    if re.match(r"\d{4}-\d\d-\d\d", s):
                        continue
                if kind == "email" and form == "words" and " at " in s:
                    sure = 0
                key = (kind, start, end)
                if key not in found:
                    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", s)) if kind in ("phone", "id_number") else ""
                    found[key] = Candidate(kind, start, end, form, [f"form={form}", f"digits={digits if kind != 'address' else 0}", f"shape={shape}"] + _around(text, start, end), sure)
        for m in _EN_LOOSE.finditer(text) if digits_of else ():
            key = ("address", *m.span())
            if key not in found and not any(c.kind == "address" and c.start < m.end() and m.start() < c.end for c in found.values()):
                words = m.group().split()[1:-1]
                # in doubt: a street in other case, or words of a sentence between a number and "way"
                sure = 0 if m.group().isupper() or (m.group().islower() and not all(w in lexicon.words for w in words)) else -1
                found[key] = Candidate("address", *m.span(), "loose", ["form=loose"] + _around(text, *m.span()), sure)
    for c in _name_candidates(text, lexicon):
        found.setdefault((c.kind, c.start, c.end), c)
    return sorted(found.values(), key=lambda c: (c.end, c.start))


def _names_of(c: Candidate) -> list[str]:
    return [f"{c.kind}|{f}" for f in c.features] + [f"{c.kind}|bias"]


class SemiMarkov:
    """Weights of segment features; segmentations are sets of candidates that don't overlap."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, c: Candidate) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in _names_of(c))

    def decode(self, cs: list[Candidate]) -> list[Candidate]:
        """The best segmentation; ties go to fewer, then longer spans."""
        ends = [c.end for c in cs]
        best, back = [(0.0, 0, 0)], [None]
        for n, c in enumerate(cs):
            at = int(np.searchsorted(ends, c.start, side="right"))
            prior = best[min(at, n)]
            take = (prior[0] + self.score(c), prior[1] - 1, prior[2] + c.end - c.start)
            if take > best[-1]:
                best.append(take)
                back.append((n, min(at, n)))
            else:
                best.append(best[-1])
                back.append(None)
        out, n = [], len(cs)
        while n:
            if back[n] is None:
                n -= 1
            else:
                out.append(cs[back[n][0]])
                n = back[n][1]
        return out[::-1]

    def marginals(self, cs: list[Candidate]) -> list[float]:
        """Probability of each candidate, by sums forward and backward."""
        ends, n = [c.end for c in cs], len(cs)
        s = [max(-30.0, min(30.0, self.score(c))) for c in cs]
        before = [min(int(np.searchsorted(ends, c.start, side="right")), k) for k, c in enumerate(cs)]
        forward = [0.0] * (n + 1)
        for k in range(n):
            forward[k + 1] = np.logaddexp(forward[k], forward[before[k]] + s[k])
        # paths from state k + 1 on: candidates taken later must start after what was taken before
        backward = [-np.inf] * (n + 1)
        backward[n] = 0.0
        for k in range(n - 1, -1, -1):
            backward[k] = np.logaddexp(backward[k], backward[k + 1])
            backward[before[k]] = np.logaddexp(backward[before[k]], s[k] + backward[k + 1])
        total = forward[n]
        return [math.exp(min(0.0, forward[before[k]] + s[k] + backward[k + 1] - total)) for k in range(n)]

    def fit(self, texts: list[list[Candidate]], rounds: int = 6, rate: float = 0.3, penalty: float = 1e-4, seed: int = 5) -> SemiMarkov:
        """Ascends the likelihood of the certain spans (adaptive steps); candidates in doubt are left out."""
        rng, w, g2 = np.random.default_rng(seed), self.weights, {}
        sure = [t for t in ([c for c in cs if c.certain] for cs in texts) if t]
        for _ in range(rounds):
            for k in rng.permutation(len(sure)):
                cs = sure[k]
                gold, reach = set(), 0
                for n, c in sorted(enumerate(cs), key=lambda x: (x[1].start, -x[1].end)):
                    if c.certain > 0 and c.start >= reach:
                        gold.add(n)
                        reach = c.end
                for n, p in enumerate(self.marginals(cs)):
                    d = (n in gold) - p
                    if abs(d) > 1e-3:
                        for f in _names_of(cs[n]):
                            step = d - penalty * w.get(f, 0.0)
                            g2[f] = g2.get(f, 0.0) + step * step
                            w[f] = w.get(f, 0.0) + rate * step / math.sqrt(g2[f] + 1e-8)
        return self


def _add_words(text: str, small: Counter, other: Counter) -> None:
    text = re.sub(r"\S*(?:@|\( ?at ?\)|\[ ?at ?\])\S*", " ", text)
    found = {p for x in _TOKEN.findall(text) for p in (x, *(x.split("-") if "-" in x else ()))}
    small.update(x for x in found if x.islower())
    other.update({x.lower() for x in found if x and not x.islower()})


def count_words(texts: DataFrame) -> DataFrame:
    """``word, small, other``: in how many rows of ``text`` a word is written in small letters, and in how many otherwise.

    All rows are read, each as a whole; addresses of mail don't count. Only counts are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, other = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            words = list({**small, **other})
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (small, other))]
            small.clear()
            other.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "small", "other"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                _add_words(text, small, other)
                if len(small) + len(other) > 300_000:
                    yield counted()
        yield counted()

    counts = texts.mapInArrow(count, "word string, small long, other long")
    return counts.groupBy("word").agg(F.sum("small").alias("small"), F.sum("other").alias("other"))


def _count_pieces(words: DataFrame) -> DataFrame:
    """``piece, n``: in how many of the ``word`` s each piece is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(p for w in batch.column("word").to_pylist() for p in set(_pieces(w)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["piece", "n"])

    return words.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def fit_lexicon(texts: DataFrame, known: list[tuple[str, str]]) -> NameLexicon:
    """Counts the words of every ``text``. The driver gets a hash per word of the corpus and the counts of letter pieces."""
    words = cut_lineage(count_words(texts).filter("small >= 3 and small > other").select("word"))
    names = texts.sparkSession.createDataFrame([(w,) for w in sorted(_names_in(known))], "word string")
    plain = words.filter(F.length("word") > 2).join(F.broadcast(names), "word", "left_anti")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in batch.column("word").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    hashes = words.mapInArrow(hashed, "h long").toArrow().column("h").to_numpy().view(np.uint64)
    pieces = _count_pieces(plain).toArrow()
    return NameLexicon(known, WordSet(hashes), dict(zip(pieces.column("piece").to_pylist(), pieces.column("n").to_pylist())), plain.count())


def fit_finder(texts: DataFrame, known_names: DataFrame, sample: int = SAMPLE) -> tuple[NameLexicon, SemiMarkov]:
    """Lexicon of all texts and the table of known names; weights from at most ``sample`` distinct texts (smallest draws).

    Texts of more than ``LONGEST`` characters are read like all others, but not for the fit.
    """
    rows = texts.select(F.col(texts.columns[0]).alias("text")).filter("text is not null")
    known = [(r.name, r.kind) for r in known_names.select("name", "kind").distinct().limit(MOST_NAMES + 1).collect()]
    if len(known) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    lexicon = fit_lexicon(rows, known)
    short = rows.filter(F.length("text") <= LONGEST)
    share = F.lit(1.1 * sample / max(1, short.count()))  # equal texts have equal draws, so repeats only make the sample smaller
    near = short.filter(unit_draw(F.col("text"), 3) < share).distinct()
    bodies = [r.text for r in near.orderBy(unit_draw(F.col("text"), 3), "text").limit(sample).collect()]
    return lexicon, SemiMarkov().fit([cs for cs in (candidates(t, lexicon) for t in bodies) if cs])


def find_personal_data(df: DataFrame, id_col: str, text_col: str, lexicon: NameLexicon, model: SemiMarkov) -> DataFrame:
    """``id, kind, start_pos, end_pos`` of each place (code points, the end exclusive), from whole texts.

    Null and empty texts give no rows; repeated rows give each place once; null ids keep their places under null;
    other columns aren't read. Nothing is shuffled but the places found.
    """
    context = df.sparkSession.sparkContext
    sent = context.broadcast((lexicon, model))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text <> ''")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = sent.value
        for batch in batches:
            out = [[], [], [], []]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for c in model.decode(candidates(text, lexicon)):
                    for column, x in zip(out, (key, c.kind, c.start, c.end)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["id", "kind", "start_pos", "end_pos"])

    return rows.mapInArrow(find, "id string, kind string, start_pos long, end_pos long").distinct()


def redact(df: DataFrame, text_col: str, lexicon: NameLexicon, model: SemiMarkov) -> DataFrame:
    """``df`` with each place in ``text_col`` replaced by ``[KIND]``; the rest of the text, nulls included, as it was."""
    from pyspark.sql.functions import pandas_udf

    sent = df.sparkSession.sparkContext.broadcast((lexicon, model))

    @pandas_udf("string")
    def replace(texts):
        lexicon, model = sent.value

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for c in model.decode(candidates(text, lexicon)):
                out += [text[at : c.start], f"[{c.kind.upper()}]"]
                at = c.end
            return "".join([*out, text[at:]])

        return texts.map(one)

    return df.withColumn(text_col, replace(F.col(text_col)))
