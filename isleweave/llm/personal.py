"""Personal information inside free text, found by a linear-chain conditional random field.

Tokens are runs of letters, runs of digits and single signs, each with the white space before it, so that they tile
the text. Features depend on a token's own letters and shape, on those of its neighbours (computed once per distinct
token), and on the form of the run of signs it stands in: how many digits a number has, how it begins, whether a run is
a link or holds an @. Whole texts are decoded by Viterbi in numpy, many texts at a time. What is found is cut out at
its exact offsets after a check of its form.

The weights are a file beside this module, written by ``python -m isleweave.llm.personal`` from the labelled table of
``personal_labels``; a test trains again on a part and checks that the file belongs to the table.
"""

from __future__ import annotations

import inspect
import pathlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from . import personal_labels
from .personal_labels import KINDS, labelled_texts

KIND_NAMES = list(KINDS)
LABELS = ["O", *[f"{p}-{k}" for k in KIND_NAMES for p in "BI"]]
#: Training texts made from the labelled table, passes over them, texts per step, and the seed of both.
TEXTS, PASSES, STEP_TEXTS, SEED = 16000, 6, 30, 7
FILE = pathlib.Path(__file__).with_name("personal_weights.npz")
#: Hashed features, features per token, and how many neighbours each side tell something.
BUCKETS, PER_TOKEN, REACH = 1 << 14, 9, 3
SHAPES = 64
#: Forms of runs (see ``_forms``).
RUNS = 512
#: Tokens decoded at once and distinct tokens remembered by a worker; both bound memory, not the result.
BATCH_TOKENS, REMEMBERED = 150_000, 150_000

TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[ID]", "address": "[ADDRESS]", "person": "[NAME]"}

_HOUSE = r"\d{1,4}(?:\s?/\s?(?:\d{1,4}|[A-Za-z](?![^\W\d_]))|\s?[A-Za-z](?![^\W\d_]))?"
_STREET = r"[^\W\d_][\w'’-]*\.?(?:\s+[^\W\d_][\w'’-]*){0,4}"
#: Code points by which a piece may go on behind its last label.
MORE = {"email": 60, "address": 60}
#: The rest of a house number, or the kind of street, behind an address that ends too early.
REST = re.compile(r"(?<=\d)(?:\s?/\s?\d{1,4}|[A-Za-z])(?!\w)|(?<=[^\W\d_])[ ](?:%s)(?!\w)" % "|".join(sorted({re.escape(k.rstrip(".")) for k in personal_labels.KINDS_OF_STREET})), re.I)
#: What a piece of each kind must look like as a whole.
FORMS = {
    "email": re.compile(r"[\w.%+-]+\s*(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s*[\w-]+(?:(?:\.|\s*\(dot\)\s*|\s*\[dot\]\s*|\sdot\s)[\w-]+)+", re.I),
    "phone": re.compile(r"(?:\+|\()?\d(?:[  \t()./-]{0,3}\d){6,14}"),
    "national_id": re.compile(r"\d{9}\s?[VvXx]|\d{5}[- ]\d{4}\s?[VvXx]|\d{12}|\d{4}[ -]\d{4}[ -]\d{4}|[A-Z]{1,2}\d{6,8}|\d{3}-\d{2}-\d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}(?: ?\d{2}){3} ?[A-Z]|\d{8}-?[A-Z]|[A-Z]\d{2}[A-Z0-9]{5,8}"),
    "address": re.compile(rf"{_HOUSE},?\s+{_STREET}|{_STREET}\.?,?\s+{_HOUSE}"),
    "person": re.compile(r"(?=.*[^\W\d_]{3})(?:[^\W\d_][\w'’-]*|(?:[^\W\d_]\.)+)(?:,?\s+(?:[^\W\d_][\w'’-]*|(?:[^\W\d_]\.)+)){1,3}"),
}

#: Small words inside names.
PARTICLES = set(personal_labels.PARTICLES)

#: A street has a word with a capital or of a script without capitals, or is of a known kind; "3/5 rooms" is none.
STREET_LIKE = re.compile(r"[^\W\d_a-zà-öø-ÿß][^\W\d_]|(?i:\b(?:%s)\b)" % "|".join(sorted({re.escape(k.rstrip(".")) for k in personal_labels.KINDS_OF_STREET})))
#: What a piece must look like whose labels ended too early: of an address, words with capitals only.
LONGER = {"email": FORMS["email"], "address": re.compile(rf"{_HOUSE},?[ ]+[A-Z][\w'’-]*(?:[ ]+[A-Z][\w'’-]*){{0,3}}|[A-Z][\w'’-]*(?:[ ]+[A-Z][\w'’-]*){{0,3}}\.?,?[ ]+{_HOUSE}")}

_LINK = re.compile(r"(?:https?://|www\.)\S+")
_AT = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,80}(?:@|\s?(?:\(at\)|\[at\]|\{at\})\s?|\s@\s|\sat\s)[\w-]{1,80}(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[\w-]{1,80})+|(?<!\w)@\w+", re.I)
_AT_WORD = re.compile(r"[(\[{]at[)\]}]| dot ", re.I)
_DECIMAL, _DATE = re.compile(r"\d+\.\d+"), re.compile(r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}")
_NUMBER = re.compile(r"(?<![\w.])[A-Z]{0,5}[+(]?\d(?:[ ()./-]{0,2}\d)*[A-Za-z]{0,2}(?: [VXvx]\b)?")


def _forms(text: str, ends: list[int]) -> list[int]:
    """Per token (by its end offset) the form of the run it stands in: 1 link, 2 name with @ and host, 3 handle, else of a number; 0 for none."""
    out = [0] * len(ends)

    def mark(a: int, b: int, code: int) -> None:
        i = bisect_right(ends, a)
        j = bisect_left(ends, b, i) + 1
        for k in range(i, min(j, len(out))):
            out[k] = out[k] or code

    if "://" in text or "www." in text:
        for m in _LINK.finditer(text):
            mark(*m.span(), 1)
    if "@" in text or _AT_WORD.search(text):
        for m in _AT.finditer(text):
            mark(*m.span(), 3 if m.group()[0] == "@" else 2)
    for m in _NUMBER.finditer(text):
        run = m.group()
        number = run.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        letters, digits = len(run) - len(number), sum(map(str.isdigit, number))
        lead = 0 if number[0] == "+" else 1 if number[0] == "(" else 2 if number[:2] == "00" else 3 if number[0] == "0" else 4
        kind = 5 if letters else 0 if number.isdigit() else 4 if _DECIMAL.fullmatch(number) else 3 if _DATE.fullmatch(number) else 2 if number[-1] in "VXvx" else 1 if number[-1].isalpha() else 0
        mark(*m.span(), 4 + min(digits, 15) + 16 * (kind * 5 + (min(letters, 5) - 1 if letters else lead)))
    return out


def _shape(core: str) -> str:
    if core[0].isdigit():
        return f"9{min(len(core), 12)}"
    if core[0].isalpha():
        kind = "X" if len(core) == 1 and core.isupper() else "XX" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else "x" if core.islower() else "xX"
        return kind + ("" if len(core) > 3 else str(len(core)))
    return core[0] if ord(core[0]) < 128 else "sign"


def _features(token: str) -> list[str]:
    core = token.lstrip()
    gap = "n" if "\n" in token[: len(token) - len(core)] else "s" if len(core) < len(token) else ""
    shape, low = _shape(core), core.lower()
    word = f"#{len(core)}" if core[0].isdigit() else low
    long = core[0].isalpha() and len(core) >= 5
    return [f"w{word}", f"h{shape}", f"g{gap}", f"gh{gap}{shape}", f"p{low[:2]}" if long else "p", f"q{low[:4]}" if long else "q", f"s{low[-3:]}" if long else "s", f"t{low[-4:]}" if long else "t", f"l{min(len(core), 12)}{shape}"]


class Vocabulary(dict):
    """Numbers distinct tokens and keeps their feature and shape numbers; 0 stands for the ends of a text."""

    def __init__(self):
        super().__init__()
        self.rows, self.shapes = [[0] * PER_TOKEN], [0]

    def __missing__(self, token: str) -> int:
        core = token.lstrip()
        # digits tell only their number, so all runs of one length share a row
        same = token[: len(token) - len(core)][:1].replace("\t", " ").replace("\r", "\n") + "7" * min(len(core), 13) if core[0].isdigit() else token
        if same != token:
            at = self[token] = self[same]
            return at
        at = len(self.rows)
        # crc32 gives the same bucket in every process
        self.rows.append([1 + zlib.crc32(f.encode()) % (BUCKETS - 1) for f in _features(token)])
        self.shapes.append(1 + zlib.crc32(_shape(core).encode()) % (SHAPES - 1))
        self[token] = at
        return at


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers as rows, longest text first is up to the caller; zeros around."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros((len(texts), int(sizes.max()) + 2 * REACH), dtype=np.int64)
    for k, t in enumerate(texts):
        out[k, REACH : REACH + len(t)] = t
    return out, sizes


class Model:
    """Weights of the random field: per neighbour and feature, per pair of neighbouring shapes, per form of a run (here and beside), and per pair of labels."""

    def __init__(self):
        n = len(LABELS)
        self.words = np.zeros((2 * REACH + 1, BUCKETS, n), dtype=np.float32)
        self.pairs = np.zeros((3, SHAPES * SHAPES, n), dtype=np.float32)
        self.runs = np.zeros((3, RUNS, n), dtype=np.float32)
        self.links = np.zeros((n, n), dtype=np.float32)
        self.first = np.zeros(n, dtype=np.float32)
        for j, b in enumerate(LABELS):  # a piece goes on only within its kind
            for i, a in enumerate(LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.links[i, j] = -1e4
            if b[0] == "I":
                self.first[j] = -1e4

    def parts(self) -> list[np.ndarray]:
        return [self.words, self.pairs, self.runs, self.links, self.first]


def _pair_codes(shapes: np.ndarray, width: int) -> list[np.ndarray]:
    at = lambda d: shapes[:, REACH + d : REACH + d + width]
    return [at(-1) * SHAPES + at(0), at(0) * SHAPES + at(1), at(1) * SHAPES + at(2)]


def _run_codes(forms: np.ndarray, width: int) -> list[np.ndarray]:
    return [forms[:, REACH + d : REACH + d + width] for d in (-1, 0, 1)]


def _scores(model: Model, tables: np.ndarray, tokens: np.ndarray, shapes: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Label scores of every position: texts x positions x labels."""
    width = tokens.shape[1] - 2 * REACH
    out = tables[0][tokens[:, :width]]
    for d in range(1, 2 * REACH + 1):
        out = out + tables[d][tokens[:, d : d + width]]
    for table, codes in zip(model.pairs, _pair_codes(shapes, width)):
        out += table[codes]
    for table, codes in zip(model.runs, _run_codes(forms, width)):
        out += table[codes]
    return out


def _tables(model: Model, rows: np.ndarray) -> np.ndarray:
    """Per neighbour and distinct token, the sum of its features' weights."""
    return np.stack([w[rows].sum(axis=1) for w in model.words])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expected(scores: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every position (zero beyond a text) and expected label pairs, by forward and backward sums."""
    texts, width, n = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + model.first
    for t in range(1, width):
        new = _log_sum(ahead[:, t - 1, :, None] + model.links[None], 1) + scores[:, t]
        ahead[:, t] = np.where((t < sizes)[:, None], new, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    links = np.zeros((n, n))
    for t in range(width - 1, 0, -1):
        joint = model.links[None] + (scores[:, t] + back[:, t])[:, None, :]
        inside = (t < sizes)[:, None]
        p = np.exp(np.minimum(ahead[:, t - 1, :, None] + joint - total[:, None, None], 0))
        links += (p * inside[:, :, None]).sum(axis=0)
        back[:, t - 1] = np.where(inside, _log_sum(joint, 2), 0)
    marginal = np.exp(np.minimum(ahead + back - total[:, None, None], 0))
    return marginal * (np.arange(width)[None, :, None] < sizes[:, None, None]), links


def _labelled(pieces: list[tuple[str, str | None]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, forms of runs, and labels."""
    text, spans = "", []
    for part, kind in pieces:
        if kind:
            spans.append((len(text), len(text) + len(part), kind))
        text += part
    tokens, labels, ends, k = [], [], [], 0
    for m in TOKEN.finditer(text):
        start = m.end() - len(m.group().lstrip())
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside = k < len(spans) and spans[k][0] <= start < spans[k][1]
        labels.append(LABELS.index(f"{'B' if start == spans[k][0] else 'I'}-{spans[k][2]}") if inside else 0)
        tokens.append(vocabulary[m.group()])
        ends.append(m.end())
    return np.array(tokens), np.array(_forms(text, ends)), np.array(labels)


def trained(texts: int = TEXTS, passes: int = PASSES, seed: int = SEED) -> Model:
    """The model, fitted to the labelled table by steepest descent with a step per weight (AdaGrad)."""
    vocabulary, rng = Vocabulary(), np.random.default_rng(seed)
    data = [_labelled(p, vocabulary) for p in labelled_texts(texts, seed)]
    rows, shape_of = np.array(vocabulary.rows), np.array(vocabulary.shapes)
    model, n = Model(), len(LABELS)
    past = [np.full(p.shape, 1e-2, dtype=np.float32) for p in model.parts()]
    free = model.links > -1e3, model.first > -1e3
    for turn in range(passes):
        order = rng.permutation(len(data))
        for start in range(0, len(order), STEP_TEXTS):
            batch = [data[i] for i in order[start : start + STEP_TEXTS]]
            tokens, sizes = _padded([t for t, _, _ in batch])
            forms, _ = _padded([f for _, f, _ in batch])
            width = tokens.shape[1] - 2 * REACH
            gold = np.zeros((len(batch), width), dtype=np.int64)
            for k, (_, _, labels) in enumerate(batch):
                gold[k, : len(labels)] = labels
            present = np.arange(width)[None, :] < sizes[:, None]
            seen = np.unique(tokens)
            local = np.searchsorted(seen, tokens)
            tables = _tables(model, rows[seen])
            shapes = shape_of[tokens]
            marginal, links = _expected(_scores(model, tables, local, shapes, forms).astype(np.float64), sizes, model)
            error = -marginal
            np.add.at(error, (*np.nonzero(present), gold[present]), 1.0)
            flat = error.reshape(-1, n)
            grads = [np.zeros_like(p) for p in model.parts()]
            for d in range(2 * REACH + 1):
                per = np.zeros((len(seen), n))
                np.add.at(per, local[:, d : d + width].ravel(), flat)
                np.add.at(grads[0][d], rows[seen], per[:, None, :].astype(np.float32))
            for g, codes in zip(grads[1], _pair_codes(shapes, width)):
                np.add.at(g, codes.ravel(), flat.astype(np.float32))
            for g, codes in zip(grads[2], _run_codes(forms, width)):
                np.add.at(g, codes.ravel(), flat.astype(np.float32))
            follows = present[:, 1:]
            np.add.at(links, (gold[:, :-1][follows], gold[:, 1:][follows]), -1.0)
            grads[3] -= (links * free[0]).astype(np.float32)
            grads[4] += (error[:, 0].sum(axis=0) * free[1]).astype(np.float32)
            for p, g, h in zip(model.parts(), grads, past):
                touched = g != 0
                h[touched] += g[touched] ** 2
                p[touched] += 0.25 * g[touched] / np.sqrt(h[touched]) - 1e-5 * p[touched]
    return model


def _viterbi(scores: np.ndarray, sizes: np.ndarray, model: Model) -> list[np.ndarray]:
    """Best labels of each text; texts must come longest first, so that those still running are the first rows."""
    texts, width, n = scores.shape
    back = np.zeros((width, texts, n), dtype=np.uint8)
    best = scores[:, 0] + model.first
    running = np.searchsorted(-sizes, -np.arange(width), side="left")  # texts longer than t
    for t in range(1, width):
        m = running[t]
        step = best[:m, :, None] + model.links[None]
        back[t, :m] = step.argmax(axis=1)
        best[:m] = step.max(axis=1) + scores[:m, t]
    out = np.zeros((texts, width), dtype=np.uint8)
    at = best.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        m = running[t] if t else texts
        out[:m, t] = at[:m]
        at[:m] = back[t, np.arange(m), at[:m]]
    return [row[:s] for row, s in zip(out, sizes)]


class Tagger:
    """Finds pieces in batches of texts."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.vocabulary, self.tables, self.shapes = Vocabulary(), None, None

    def _grow(self) -> None:
        """Score tables of the tokens that are new since the last call."""
        have = 0 if self.tables is None else self.tables.shape[1]
        if have < len(self.vocabulary.rows):
            new = _tables(self.model, np.array(self.vocabulary.rows[have:]))
            self.tables = new if self.tables is None else np.concatenate([self.tables, new], axis=1)
            self.shapes = np.array(self.vocabulary.shapes)

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of each text the pieces found: start, end (code points) and kind, in order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        group, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if size + len(text) // 4 > BATCH_TOKENS and group:
                self._decode(group, out)
                group, size = [], 0
            if len(self.vocabulary.rows) > REMEMBERED and not group:
                self._forget()
            parts = TOKEN.findall(text)
            ends = list(accumulate(map(len, parts)))  # tokens tile the text
            group.append((k, text, list(map(self.vocabulary.__getitem__, parts)), _forms(text, ends), parts, ends))
            size += len(parts)
        if group:
            self._decode(group, out)
        return out

    def _decode(self, group: list[tuple[int, str, list[int], list[int], list[str], list[int]]], out: list) -> None:
        self._grow()
        group = sorted((g for g in group if g[2]), key=lambda g: -len(g[2]))
        while group:
            # of similar lengths, and few enough that the padded scores stay small
            width = len(group[0][2])
            many = max(1, min(len(group), BATCH_TOKENS // width))
            part, group = group[:many], group[many:]
            tokens, sizes = _padded([np.array(g[2]) for g in part])
            forms, _ = _padded([g[3] for g in part])
            scores = _scores(self.model, self.tables, tokens, self.shapes[tokens], forms)
            for (k, text, _, _, parts, ends), labels in zip(part, _viterbi(scores, sizes, self.model)):
                if labels.any():
                    out[k] = _pieces(text, parts, ends, labels)


def _pieces(text: str, parts: list[str], ends: list[int], labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Pieces of a text from the labels of its tokens, trimmed and checked."""
    found: list[list] = []
    before = -2
    for i in np.flatnonzero(labels).tolist():
        name = LABELS[labels[i]]
        if found and before == i - 1 and name == f"I-{found[-1][2]}":
            found[-1][1] = ends[i]
        else:
            found.append([ends[i] - len(parts[i].lstrip()), ends[i], name[2:]])
        before = i
    out = []
    for start, end, kind in found:
        if kind == "person":
            piece = text[start:end].rstrip(" \t\r\n.,;:!?>)\"”’»")
            bare = piece.lstrip(" .,;:<(\"“«#")
            # words of small letters at the ends belong to the sentence
            while (small := re.match(r"[^\W\d_]+\s+", bare)) and small.group()[0].islower() and small.group().strip() not in PARTICLES:
                bare = bare[small.end() :]
            start += len(piece) - len(bare)
            if FORMS[kind].fullmatch(text, start, start + len(bare)):
                out.append((start, start + len(bare), kind))
            continue
        while kind == "email" and start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        # signs at the ends may be the sentence's; the form tells what belongs to the piece
        if kind == "phone" and start and text[start - 1] in "+(":
            start -= 1
        inside = list(FORMS[kind].finditer(text, start, end))
        if not inside and kind in MORE and (longer := LONGER[kind].match(text, start, end + MORE[kind])):
            inside = [longer]  # the labels ended too early
        for m in inside:
            a, b = m.start() + (kind == "phone" and m.group()[0] == "(" and ")" not in m.group()), m.end()
            if kind == "address" and (more := REST.match(text, b)):
                b = more.end()
            if kind != "address" or STREET_LIKE.search(text, a, b):
                out.append((a, b, kind))
    return out


def fingerprint() -> int:
    """Of what the weights are made from: the labelled table and all that training uses."""
    code = "".join(inspect.getsource(x) for x in (personal_labels, Vocabulary, Model, trained, _features, _shape, _forms, _labelled, _expected))
    return zlib.crc32(repr((code, TEXTS, PASSES, STEP_TEXTS, SEED, BUCKETS, PER_TOKEN, REACH, SHAPES, RUNS, LABELS)).encode())


def write_model() -> None:
    """Trains and writes the weights, in half precision."""
    np.savez_compressed(FILE, fingerprint=fingerprint(), **{f"p{k}": p.astype(np.float16) for k, p in enumerate(trained().parts())})


def read_model() -> Model:
    """The model of the file of weights."""
    model, n = Model(), len(LABELS)
    with np.load(FILE) as kept:
        model.words, model.pairs, model.runs, links, first = (kept[f"p{k}"].astype(np.float32) for k in range(5))
    model.links, model.first = np.where(model.links < -1e3, model.links, links), np.where(model.first < -1e3, model.first, first)
    assert model.links.shape == (n, n)
    return model


_SHARED: dict[str, object] = {}
_TAGGERS: list[Tagger] = []


def _shared(spark: SparkSession):
    """The model as a Spark broadcast, one per application: a fixed number of weights, about seven megabytes, whatever the corpus."""
    ship(spark)
    key = spark.sparkContext.applicationId
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = spark.sparkContext.broadcast([p.astype(np.float32) for p in read_model().parts()])
    return _SHARED[key]


def _tagger(shared) -> Tagger:
    """The tagger of this worker; a worker belongs to one application, so to one model."""
    if not _TAGGERS:
        model = Model()
        model.words, model.pairs, model.runs, model.links, model.first = shared.value
        _TAGGERS.append(Tagger(model))
    return _TAGGERS[0]


def personal_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, found_text`` of every piece in every row (offsets in code points from 0).

    ``documents`` has ``doc_id, text``; other columns are ignored. Null, empty and blank texts give no row; whole
    texts are read, whatever their length; repeated rows give repeated pieces. ``doc_id`` may be null.
    """
    shared = _shared(documents.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(shared)
        for pdf in batches:
            rows = [(d, k, a, b, t[a:b]) for d, t, spans in zip(pdf["doc_id"], pdf["text"], tagger.spans(list(pdf["text"]))) for a, b, k in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "found_text"])

    schema = documents.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return documents.select("doc_id", "text").mapInPandas(find, f"{schema}, kind string, start int, end int, found_text string")


def redacted(text_column: str, documents: DataFrame) -> DataFrame:
    """``documents`` with ``text_column`` in which every piece is replaced by a typed placeholder; the rest is unchanged."""
    shared = _shared(documents.sparkSession)

    def replace(texts: pd.Series) -> pd.Series:
        whole = [x if isinstance(x, str) else None for x in texts]
        out = []
        for text, spans in zip(whole, _tagger(shared).spans(whole)):
            for a, b, kind in reversed(spans):
                text = text[:a] + PLACEHOLDERS[kind] + text[b:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return documents.withColumn(text_column, F.pandas_udf(replace, documents.schema[text_column].dataType)(F.col(text_column)))


if __name__ == "__main__":
    write_model()
