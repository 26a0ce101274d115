"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

Emails, ip addresses, card and phone numbers of regular form are found by patterns. The field, trained from a small
labelled table by the likelihood of whole taggings, finds irregular ones: spelled-out emails, numbers without a
country code, ip addresses of version 6, keys and account numbers. Every word of every whole text is scored and the
best tagging of the whole text is found by Viterbi in numpy, the texts of a batch together. Words that no span of a
best tagging can hold, by a bound from running totals over the text (``certain``), part it into stretches whose best
taggings are the text's, so steps are made only in between. Spans that are no such thing by their digits (``plausible``) go, and none touches those of the patterns.

Defined results: null and empty texts have no spans; of taggings that score alike, the one with the earlier tag in
``TAGS`` at its last differing word counts; repeated rows are separate rows with equal results; a very long text is
worked on alone; an empty table gives an empty result; extra columns are ignored,
whatever their names. Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field as member
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_column
from .pii_examples import labelled_lines

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban")
STEPS = 80
RATE = 0.25
PENALTY = 0.0002
# labelled texts taken for training, those of smallest hash
SAMPLE = 2000
# words of a spelled-out email
LONGEST_EMAIL = 16
# a feature that fewer labelled words have is left out
RARE = 2
# distinct words whose scores a worker remembers
REMEMBERED = 100_000
# characters of text worked on at once; a longer text is taken alone
TOGETHER = 1 << 20
# words whose tags are decoded at once
CHUNK = 1 << 16

# ---- patterns ------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its beginning only: if that fails, so do later starts in it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")


def emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the field -----------------------------------------------------------------------------

TAGS = ["O", *(f"{bi}-{k}" for k in KINDS for bi in "BI")]
EDGES = "\"'.,;:!?#$%&*|"


def marks(word: str) -> str:
    return "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)


def folded(shape: str) -> str:
    """Runs of a character class folded to one or, from three on, two marks."""
    return re.sub(r"(.)\1+", lambda m: m.group(1) * (2 if len(m.group()) > 2 else 1), shape, flags=re.S)


def features(word: str) -> list[str]:
    low = word.lower()
    bare = low.strip(EDGES) or low
    core = marks(word.strip(EDGES) or word)
    digits = core.count("d")
    size = "1-2 3-4 5-7 8-11 12-19 20-31 32+".split()[sum(len(bare) > n for n in (2, 4, 7, 11, 19, 31))]
    kinds = "".join(sorted({"d" if c.isdigit() else "x" if c.isalpha() else c for c in bare}))[:12]
    out = ["1", f"s={folded(core)}", f"n={size}", f"k={kinds}", f"d={min(digits, 6)}", f"dn={min(digits, 6)}{size}"]
    if digits:
        if len(core) <= 18:
            out.append(f"x={core}")
        out += [f"p={bare[:3]}", f"q={bare[0]}{min(digits, 5)}", f"t={min(8, len(re.findall(r'd+|x+|X+', core)))}{size}"]
        if digits == len(core) == 4:
            out.append(f"y={bare[:2] in ('19', '20')}")
        if all(c in "0123456789abcdef" for c in bare):
            out.append(f"hex={size}")
    if "_" in bare or "-" in bare:
        out.append(f"u={re.split('[_-]', bare)[0][:6]}{size}")
    if len(bare) <= 12 and not digits:
        out.append(f"w={bare}")
    return out


@dataclass
class Field:
    number: dict[str, int]
    own: np.ndarray  # (feature, tag)
    before: np.ndarray  # weights of the features of the word before
    after: np.ndarray
    steps: np.ndarray  # (tag, next tag)
    known: dict[str, int] = member(default_factory=dict)
    scores: list = member(default_factory=list)

    def number_of(self, word: str) -> int:
        """The place of an unseen word. Words of letters only that are in no feature share one for each case and length."""
        core = word.strip(EDGES) or word
        if core.isalpha() and f"w={core.lower()}" not in self.number:
            case = "l" if core.islower() else "U" if core.isascii() and core.isupper() else ""
            case = case or ("T" if core.isascii() and core[1:].islower() else "")
            if case:
                same = f" {case}{min(len(core), 32)}"
                if same not in self.known:
                    self.known[same] = self.scored(core)
                return self.known[same]
        return self.scored(word)

    def scored(self, word: str) -> int:
        ids = [self.number[f] for f in features(word) if f in self.number]
        self.scores.append(np.stack([m[ids].sum(axis=0) for m in (self.own, self.before, self.after)]))
        return len(self.scores) - 1

    def numbers(self, words: Iterable[str]) -> np.ndarray:
        """Places of the words in the table of scores, which grows by unseen ones."""
        known, out = self.known, []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = self.number_of(w)
            out.append(k)
        return np.array(out, np.int64)

    def forget(self):
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.scores.clear()


# a span in brackets, which may hold pairs of brackets, or a word outside
_SPAN = re.compile(r"\[(%s)\|((?:[^\[\]]|\[[^\[\]]*\])+)\](?=\s|$)|(\S+)" % "|".join(KINDS))


def _labelled(lines: Iterable[str]):
    for line in lines:
        words, tags = [], []
        for kind, inside, outside in _SPAN.findall(line):
            if kind:
                own = inside.split()
                words += own
                tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(own) - 1)
            else:
                words.append(outside)
                tags.append("O")
        yield words, [TAGS.index(t) for t in tags]


def labelled_rows(labelled: DataFrame, sample: int = SAMPLE):
    """Words and tags of a labelled table: text, spans (array of struct kind, start, end). ``sample`` bounds the texts."""
    rows = labelled.where(F.col("text").isNotNull()).orderBy(F.xxhash64("text"), "text").select("text", "spans").limit(sample)
    for text, spans in rows.collect():
        words, tags, last = [], [], None
        for m in re.finditer(r"\S+", text):
            own = next((s for s in spans or () if s["start"] < m.end() and m.start() < s["end"]), None)
            words.append(m.group())
            tags.append(0 if own is None else TAGS.index(("I-" if own == last else "B-") + own["kind"]))
            last = own
        if words:
            yield words, tags


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


_BARRED = -1e4
_START = np.array([_BARRED if t[0] == "I" else 0.0 for t in TAGS])
# an inside tag follows the beginning or inside of its own kind only
_RULES = np.array([[_BARRED if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in TAGS] for a in TAGS])


@lru_cache(maxsize=1)
def _default() -> Field:
    return train(_labelled(labelled_lines()))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Field:
    return train(labelled_rows(labelled, sample))


def train(data) -> Field:
    """Maximises the penalised likelihood of the (words, tags) of ``data`` by adaptive gradient steps."""
    data = list(data)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for words, _ in data for w in words))}
    seen = Counter(f for words, _ in data for w in words for f in features(w))
    number = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= RARE)}
    table = np.zeros((len(vocabulary), len(number)))
    for w, k in vocabulary.items():
        table[k, [number[f] for f in features(w) if f in number]] = 1
    n, longest, tags = len(data), max((len(w) for w, _ in data), default=1), len(TAGS)
    ids = np.full((n, longest), len(vocabulary))
    gold = np.zeros((n, longest), int)
    for i, (words, own) in enumerate(data):
        ids[i, : len(words)], gold[i, : len(own)] = [vocabulary[w] for w in words], own
    mask = ids < len(vocabulary)
    earlier, later = np.full_like(ids, len(vocabulary)), np.full_like(ids, len(vocabulary))
    earlier[:, 1:], later[:, :-1] = ids[:, :-1], ids[:, 1:]
    weights = [np.zeros((len(number), tags)) for _ in range(3)] + [np.zeros((tags, tags))]
    squares = [np.full_like(w, 1e-6) for w in weights]
    eye = np.eye(tags)
    gold_tags = eye[gold] * mask[..., None]
    gold_steps = sum(((eye[gold[:, t - 1]] * mask[:, t, None]).T @ eye[gold[:, t]] for t in range(1, longest)), np.zeros((tags, tags)))
    nothing = np.zeros((1, tags))
    for _ in range(STEPS):
        emit = sum(np.vstack((table @ w, nothing))[at] for w, at in zip(weights, (ids, earlier, later)))
        step = weights[3] + _RULES
        ahead = np.zeros((n, longest, tags))
        ahead[:, 0] = emit[:, 0] + _START
        for t in range(1, longest):
            moved = _log_sum(ahead[:, t - 1, :, None] + step, 1) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
        back = np.zeros((n, longest, tags))
        for t in range(longest - 2, -1, -1):
            moved = _log_sum(step + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], moved, back[:, t + 1])
        total = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        moves = np.zeros((tags, tags))
        for t in range(1, longest):
            pair = ahead[:, t - 1, :, None] + step + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            moves += (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
        wrong = (chance - gold_tags).reshape(-1, tags)
        slopes = []
        for at in (ids, earlier, later):
            by_word = np.zeros((len(vocabulary) + 1, tags))
            np.add.at(by_word, at.reshape(-1), wrong)
            slopes.append(table.T @ by_word[:-1])
        slopes.append(moves - gold_steps)
        for w, q, g in zip(weights, squares, slopes):
            g = g + PENALTY * n * w
            q += g * g
            w -= RATE * g / np.sqrt(q)
    return Field(number, *weights[:3], weights[3] + _RULES)


# ---- decoding ------------------------------------------------------------------------------

_KIND_OF = np.array([0 if t == "O" else KINDS.index(t[2:]) for t in TAGS])
_BEGIN, _INSIDE = (np.array([TAGS.index(f"{x}-{k}") for k in KINDS]) for x in "BI")


def certain(scores: np.ndarray, ids: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Words that are outside in every best tagging; ``first`` marks words that begin a text, and the end.

    A span that some best tagging has gains by being one rather than outside. What a span from s to e can gain is at
    most what its beginning gains at s, its inside from s to e, and the best steps into, through and out of it: a sum
    over s of one running total, and over e of another. So the best span that holds a word is bounded by the largest
    term up to the word plus the largest from it on, and where that is below zero for every kind, no span holds it.
    """
    outside = np.ones(len(ids), bool)
    led, followed = ~first[:-1], ~first[1:]
    no_inside = np.array([t[0] != "I" for t in TAGS])

    def gains(tag: int) -> np.ndarray:
        lead = scores[:, :, tag] - scores[:, :, 0]
        out = lead[ids, 0]
        out[1:] += np.where(led[1:], lead[ids[:-1], 1], 0)
        out[:-1] += np.where(followed[:-1], lead[ids[1:], 2], 0)
        return out

    for begin, inside in zip(_BEGIN, _INSIDE):
        into = max(0.0, (steps[:, begin] - steps[:, 0]).max())
        through = max(steps[begin, inside], steps[inside, inside]) - steps[0, 0]
        out_of = max(0.0, max((steps[x] - steps[0])[no_inside].max() for x in (begin, inside)))
        # no span runs from one text into the next
        total = np.cumsum(gains(inside) + through - 1e3 * first[:-1])
        starts = np.maximum.accumulate(gains(begin) - total)
        stops = np.maximum.accumulate(total[::-1])[::-1]
        outside &= starts + stops + into + out_of < -1e-6
    return outside


def decode(texts: list[list[str]], field: Field) -> list[np.ndarray]:
    """Best tags of each text's words."""
    counts = np.array([len(t) for t in texts], np.int64)
    ids = field.numbers(w for t in texts for w in t)
    total = len(ids)
    tags = np.zeros(total, np.int8)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if total:
        scores = np.array(field.scores)
        first = np.zeros(total + 1, bool)
        first[bounds] = True
        outside = certain(scores, ids, first, field.steps)
        # stretches of words that are not certain, within a text
        open_ = np.concatenate(([False], ~outside, [False]))
        begins = np.flatnonzero(open_[1:-1] & (~open_[:-2] | first[:-1]))
        ends = np.flatnonzero(open_[1:-1] & (~open_[2:] | first[1:])) + 1
        _viterbi(tags, begins, ends, scores, ids, first, field.steps)
    return [tags[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _viterbi(tags, begins, ends, scores, ids, first, steps):
    """Writes the best tags of the stretches, between words that are outside or ends of texts, all in step."""
    order = np.argsort(begins - ends, kind="stable")
    begins, ends = begins[order], ends[order]
    at, lengths = 0, ends - begins
    while at < len(begins):
        # as many stretches as hold ``CHUNK`` words, or one
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK, side="right")))
        low, size = begins[at:upto], lengths[at:upto]
        own = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        emit = scores[ids[own], 0]
        led, followed = ~first[own], ~first[own + 1]
        emit[led] += scores[ids[own[led] - 1], 1]
        emit[followed] += scores[ids[own[followed] + 1], 2]
        place = np.cumsum(size) - size
        value = emit[place] + np.where(first[low][:, None], _START, steps[0])
        final = np.where(first[ends[at:upto]][:, None], 0.0, steps[:, 0])
        came = np.zeros((len(own), len(TAGS)), np.int8)
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        last = np.zeros(len(low), np.int64)
        for t in range(1, longest):
            k = live[t]
            if k < len(value):
                last[k : len(value)] = (value[k:] + final[k : len(value)]).argmax(axis=1)
            move = value[:k, :, None] + steps
            came[place[:k] + t] = move.argmax(axis=1)
            value = move.max(axis=1) + emit[place[:k] + t]
        last[: len(value)] = (value + final[: len(value)]).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            tags[low[:k] + t] = last[:k]
            if t:
                last[:k] = came[place[:k] + t, last[:k]]
        at = upto


def plausible(kind: str, found: str) -> bool:
    """Whether digits and form allow a span to be of its kind at all."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search("[A-Za-z]{4}", found)
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(found.strip("[]()")))
        except ValueError:
            return False
    if kind == "iban":
        return bool(re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", re.sub(r"\s", "", found)))
    if kind == "secret":
        return len(found) >= 8
    return len(found.split()) <= LONGEST_EMAIL and bool(re.search(r"(?is)(@|\bat\b).*(\w\.\w|\bdot\b)", found))


def field_spans(texts: list[str], field: Field, base: list[list[tuple[int, int, int]]]) -> list[list]:
    """Spans the field finds in each text, apart from those in ``base``: (start, place of the kind, end)."""
    field.forget()
    tagged = decode([t.split() for t in texts], field)
    out: list[list] = [[] for _ in texts]
    for i, tags in enumerate(tagged):
        begins = np.flatnonzero(np.isin(tags, _BEGIN))
        if not len(begins):
            continue
        words = [m.span() for m in re.finditer(r"\S+", texts[i])]
        for k in begins.tolist():
            kind = int(_KIND_OF[tags[k]])
            stop = k + 1
            while stop < len(tags) and tags[stop] == _INSIDE[kind]:
                stop += 1
            a, b = words[k][0], words[stop - 1][1]
            # quotes, stops and ornaments around a word are not part of it
            while a < b and texts[i][a] in EDGES:
                a += 1
            while b > a and texts[i][b - 1] in EDGES:
                b -= 1
            if a < b and not any(x < b and a < y for x, _, y in base[i]) and plausible(KINDS[kind], texts[i][a:b]):
                out[i].append((a, kind, b))
    return out


def together(texts: list[str]):
    """Runs of texts of at most ``TOGETHER`` characters, or one."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


# The field that this Python worker decodes with, by its name; remembered words stay from batch to batch
_fields: dict[str, Field] = {}


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def finder(field: Field):
    """Column function: text -> struct of ``SPANS``."""
    weights = (field.number, field.own, field.before, field.after, field.steps)
    name = uuid.uuid4().hex

    def written(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        if name not in _fields:
            _fields.clear()
            _fields[name] = Field(*weights)
        out = []
        for some in together([t or "" for t in texts.to_pylist()]):
            base = [base_spans(t) if _MARK.search(t) else [] for t in some]
            more = field_spans(some, _fields[name], base)
            for own, extra in zip(base, more):
                counts = [sum(k == n for _, k, _ in own) for n in range(len(BASE_KINDS))]
                out.append((*counts, hashlib.sha256(written(own).encode()).hexdigest(), written(sorted(own + extra))))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = [c.split()[0] for c in SPANS.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return find


def find(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, counts of the patterns' spans by kind, base_sha256, and all spans."""
    found = finder(field or _default())(text_column(docs, text))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("p")).select("doc_id", "p.*")
