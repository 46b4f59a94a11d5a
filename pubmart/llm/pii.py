"""Personal data by fixed patterns and a linear-chain conditional random field (operator 8).

The patterns find the plain forms. The field labels the words of the neighbourhood of every
trigger (a digit, ``@``, or a spelt-out ``dot``) from word-shape features and adds forms that the
patterns miss: telephone numbers without a plus, addresses with spelt-out signs, numbers with other
separators. It is trained by gradient ascent on the small labelled table below, widened with
seeded random digits and names, and decoded by Viterbi for all chains of a batch at once. An added
span must itself be a plausible datum (digit counts, parts of an ip, Luhn) and must not overlap a
span of the patterns.

Every text is read whole. Only its triggers' neighbourhoods form chains: words further than REACH
words from a trigger are not personal data by definition of the model.

Defined results: a null or empty text has no spans; repeated rows and rows with a null doc_id are
searched each on its own; other columns pass through ``masked`` and are not read by
``personal_data``. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import per_text, whole_texts

KINDS = ("email", "ip", "card", "phone")
REACH = 4
ROUNDS = 250
COPIES = 6
SEED = 7

_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
_SPELT = re.compile(r"\bdot\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str):
    """Leftmost, not overlapping: the run of local characters before each @, then a dotted domain."""
    end = 0
    for at in _AT.finditer(text):
        here = at.start()
        start = here
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < here and (domain := _DOMAIN.match(text, here + 1)):
            end = domain.end()
            yield start, end
        else:
            end = max(end, here + 1)


def _ips(text: str):
    """Four parts at a time of each maximal run of dotted numbers."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at = run.start()
        numbers = run[0].split(".")
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, *s) for s in _ips(text)]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


# The labelled table. {kind|form} marks personal data; 9 stands for a digit, w for a
# made-up name, L in place of a digit for one that makes the number pass Luhn, i for an ip part.
LABELLED = (
    "please call {phone|(999) 555-9999} after noon",
    "tel. {phone|999-555-9999} or write",
    "phone: {phone|999.555.9999}",
    "fax {phone|999 555 9999} office",
    "mobile {phone|0999 5559999} only",
    "reach us at {phone|00 99 99 9999999} today",
    "number {phone|+9 (999) 555-9999} is open",
    "his number was {phone|+99 999 9999999}",
    "the and of {phone|(999) 999-9999} in that",
    "de la {phone|999-999-9999} le que",
    "write to {email|w.99@w9.example.com} now",
    "mail {email|w@w.org} for that",
    "contact {email|w [at] w [dot] com} please",
    "contact {email|w(at)w(dot)com} please",
    "send it to {email|w at w dot com} or wait",
    "ask {email|w dot w at w dot org} for it",
    "the of {email|w @ w.com} and in",
    "host {ip|i.i.i.i} is down",
    "from {ip|i.i.i.i} to {ip|i.i.i.i} again",
    "blocked {ip|i[.]i[.]i[.]i} since",
    "server {ip|i . i . i . i} answers",
    "card {card|999999999999999L} paid",
    "visa {card|9999 9999 9999 999L} accepted",
    "number {card|9999-9999-9999-999L} charged",
    "charge {card|9999.9999.9999.999L} twice",
    "the of {card|9999/9999/9999/999L} and to",
    "in 1999 and 2001 it was",
    "on 1999-12-09 the last day",
    "am 09.12.1999 in der stadt",
    "at 12:39 it began",
    "version 2.0. of the licence",
    "release 3.11.4 of it",
    "about 99 of 999 were there",
    "for $9,999.99 in all",
    "pages 99-999 of the book",
    "chapter 9.9.9 and 9.9",
    "order 99999999 was sent",
    "key a9b9c9d9e9f9a9b9c9 stays",
    "password=b9db9aa9a9fcc99999 is set",
    "isbn 999-9-99-999999-9 in print",
    "99% of the time",
    "the dot at the end",
    "a red dot and a blue dot",
    "num 9999999999999999999999 is long",
    "see w9 and w99 in w",
    "@w said that w",
    "score 9-9 or 99:99",
)

LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
_KEYWORDS = frozenset("call tel phone fax mobile number mail write contact send host server card visa at dot".split())


def _filled(form: str, rng: random.Random) -> str:
    out = []
    for c in form:
        if c == "9":
            out.append(str(rng.randint(0, 9)))
        elif c == "i":
            out.append(str(rng.randint(0, 255)))
        elif c == "w":
            out.append("".join(rng.choice("aeinorstldhu") for _ in range(rng.randint(3, 8))))
        else:
            out.append(c)
    text = "".join(out)
    if "L" in text:
        digits = re.sub(r"[^0-9L]", "", text)
        text = text.replace("L", next(d for d in "0123456789" if luhn(digits.replace("L", d))))
    return text


def labelled_table(copies: int = COPIES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) rows: every line of LABELLED, filled ``copies`` times."""
    rng, rows = random.Random(seed), []
    for _ in range(copies):
        for line in LABELLED:
            text, spans = "", []
            for piece in re.split(r"(\{[^}]*\})", line):
                if piece.startswith("{"):
                    kind, form = piece[1:-1].split("|")
                    start = len(text)
                    text += _filled(form, rng)
                    spans.append((KINDS.index(kind), start, len(text)))
                else:
                    text += piece.replace("9", str(rng.randint(0, 9))) if "9" in piece else re.sub(
                        r"\bw\b", lambda _: _filled("w", rng), piece
                    )
            rows.append((text, spans))
    return rows


@cache
def _shape(word: str) -> tuple[str, ...]:
    core = word[:64].lower()
    letters = re.sub(r"[^\W\d_]+", "a", core)
    coarse = re.sub(r"[0-9]+", "9", letters)
    runs = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 20)) + "n", letters)
    digits = sum(c.isdigit() for c in word)
    bare = core.strip(".,:;()[]")
    found = [f"c:{coarse[:24]}", f"r:{runs[:32]}" if digits else "r:-", f"d:{min(digits, 20)}"]
    if bare in _KEYWORDS:
        found.append(f"k:{bare}")
    return tuple(found)


def features(words: list[str], i: int) -> list[str]:
    """Word shapes of the word and its two neighbours on either side."""
    out = ["bias", *_shape(words[i])]
    for step in (-2, -1, 1, 2):
        j = i + step
        out += [f"{step}{f}" for f in _shape(words[j])] if 0 <= j < len(words) else [f"{step}edge"]
    return out


def _is_trigger(word: str) -> bool:
    return bool(_DIGIT.search(word)) or "@" in word or bool(_SPELT.search(word))


def chains(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Words (and their places) no further than REACH words from a trigger, in unbroken chains."""
    if not (_DIGIT.search(text) or "@" in text or "dot" in text.lower()):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    hot = [i for i, (a, b) in enumerate(places) if _is_trigger(text[a:b])]
    out, i = [], 0
    while i < len(hot):
        first = max(0, hot[i] - REACH)
        last = hot[i] + REACH
        while i + 1 < len(hot) and hot[i + 1] - REACH <= last + 1:
            i += 1
            last = hot[i] + REACH
        kept = places[first : last + 1]
        out.append(([text[a:b] for a, b in kept], kept))
        i += 1
    return out


class Field:
    """Linear-chain conditional random field: emission weights, transitions, start scores."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.move, self.first = index, emit, move, first

    def scores(self, words: list[str]) -> np.ndarray:
        rows = [[self.index[f] for f in features(words, i) if f in self.index] for i in range(len(words))]
        return np.stack([self.emit[r].sum(axis=0) for r in rows])

    def decode(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all chains at once, those of like length together."""
        out: list = [None] * len(many)
        order = sorted(range(len(many)), key=lambda i: len(many[i]))
        for at in range(0, len(order), 512):
            group = order[at : at + 512]
            longest = len(many[group[-1]])
            lengths = np.array([len(many[i]) for i in group])
            scores = np.zeros((len(group), longest, len(LABELS)))
            for row, i in enumerate(group):
                scores[row, : len(many[i])] = many[i]
            best = self.first + scores[:, 0]
            back = np.zeros((longest, len(group), len(LABELS)), dtype=np.int8)
            for t in range(1, longest):
                ways = best[:, :, None] + self.move[None]
                back[t] = ways.argmax(axis=1)
                step = ways.max(axis=1) + scores[:, t]
                alive = (t < lengths)[:, None]
                best = np.where(alive, step, best)
                back[t][~alive[:, 0]] = np.arange(len(LABELS))
            label = best.argmax(axis=1)
            path = np.zeros((len(group), longest), dtype=np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = back[t][np.arange(len(group)), label]
            for row, i in enumerate(group):
                out[i] = path[row, : len(many[i])]
        return out


_FORBIDDEN = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """I of a kind only after B or I of that kind, never first."""
    n = len(LABELS)
    move, first = np.zeros((n, n)), np.zeros(n)
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            first[j] = _FORBIDDEN
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    move[i, j] = _FORBIDDEN
    return move, first


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def trained(rows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS, ridge: float = 0.02) -> Field:
    """Fit by gradient ascent on the penalised likelihood (forward and backward sums in numpy)."""
    examples = []
    for text, spans in rows:
        for words, places in chains(text):
            labels = []
            for a, b in places:
                kind = next(((k, s) for k, s, e in spans if a < e and b > s), None)
                starts = kind is not None and not any(
                    x < a and y > kind[1] for x, y in places
                )
                labels.append(0 if kind is None else 1 + 2 * kind[0] + (not starts))
            examples.append((words, labels))
    index: dict[str, int] = {}
    coded = []
    for words, labels in examples:
        rows_ = [[index.setdefault(f, len(index)) for f in features(words, i)] for i in range(len(words))]
        coded.append((rows_, np.array(labels)))
    n = len(LABELS)
    bar_move, bar_first = _allowed()
    emit, move, first = np.zeros((len(index), n)), np.zeros((n, n)), np.zeros(n)
    longest = max(len(r) for r, _ in coded)
    lengths = np.array([len(r) for r, _ in coded])
    where = [(e, t, f) for e, (r, _) in enumerate(coded) for t, fs in enumerate(r) for f in fs]
    ex, tx, fx = (np.array(v) for v in zip(*where, strict=True))
    gold = np.zeros((len(coded), longest, n))
    for e, (_, labels) in enumerate(coded):
        gold[e, np.arange(len(labels)), labels] = 1
    mask = (np.arange(longest)[None] < lengths[:, None])[:, :, None]
    gold_move = np.einsum("eti,etj->ij", gold[:, :-1], gold[:, 1:])
    params, sums = [emit, move, first], [np.zeros_like(x) for x in (emit, move, first)]
    rate = 0.3
    for _ in range(rounds):
        scores = np.zeros((len(coded), longest, n))
        np.add.at(scores, (ex, tx), emit[fx])
        full_move, full_first = move + bar_move, first + bar_first
        ahead = np.zeros_like(scores)
        ahead[:, 0] = full_first + scores[:, 0]
        for t in range(1, longest):
            step = _log_sum(ahead[:, t - 1, :, None] + full_move[None], 1) + scores[:, t]
            ahead[:, t] = np.where(mask[:, t], step, ahead[:, t - 1])
        back = np.zeros_like(scores)
        for t in range(longest - 2, -1, -1):
            step = _log_sum(full_move[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1], step, 0)
        total = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + back - total[:, None, None]) * mask
        pair = np.exp(
            ahead[:, :-1, :, None]
            + full_move[None, None]
            + (scores[:, 1:] + back[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        ) * mask[:, 1:, :, None]
        wrong = gold - chance
        slope_emit = np.zeros_like(emit)
        np.add.at(slope_emit, fx, wrong[ex, tx])
        slopes = [slope_emit, gold_move - pair.sum(axis=(0, 1)), wrong[:, 0].sum(axis=0)]
        for p, s, g in zip(params, sums, slopes, strict=True):
            g = g - ridge * p
            s += g * g
            p += rate * g / np.sqrt(s + 1e-8)
    return Field(index, emit, move + bar_move, first + bar_first)


def _plausible(kind: int, text: str) -> bool:
    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        low = text.lower()
        return ("@" in low or re.search(r"\bat\b", low) is not None) and (
            re.search(r"[^\W_]\s*\.\s*[^\W_]", low) is not None or _SPELT.search(low) is not None
        )
    if kind == 1:
        numbers = re.findall("[0-9]+", text)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text)


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds beyond the patterns, for all texts of a batch."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owners, places, scores = [], [], []
    for i, text in enumerate(texts):
        for words, at in chains(text):
            owners.append(i)
            places.append(at)
            scores.append(field.scores(words))
    for i, at, path in zip(owners, places, field.decode(scores) if scores else [], strict=True):
        text, t = texts[i], 0
        while t < len(path):
            if path[t] % 2 == 1:
                last = t
                while last + 1 < len(path) and path[last + 1] == path[t] + 1:
                    last += 1
                kind, start, end = (path[t] - 1) // 2, at[t][0], at[last][1]
                start += len(text[start:end]) - len(text[start:end].lstrip(".,:;<>\"'"))
                end -= len(text[start:end]) - len(text[start:end].rstrip(".,:;<>\"'!?"))
                clear = all(end <= s or start >= e for _, s, e in base[i])
                if start < end and clear and _plausible(kind, text[start:end]):
                    found[i].append((int(kind), start, end))
                t = last
            t += 1
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every document."""
    field = trained(labelled_table())

    def start():
        def of_texts(texts):
            base = [base_spans(t) for t in texts]
            more = added_spans(field, texts, base)
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in range(len(KINDS))]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            return [*counts, digests, [joined(b + m) for b, m in zip(base, more, strict=True)]]

        return of_texts

    added = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}
    return per_text(whole_texts(docs), start, added)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans go as one."""
    out, end = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars counted anew."""
    field = trained(labelled_table())

    def start():
        def of_texts(texts):
            given = [t or "" for t in texts]
            base = [base_spans(t) for t in given]
            more = added_spans(field, given, base)
            return [[None if t is None else mask(t, b + m) for t, b, m in zip(texts, base, more, strict=True)]]

        return of_texts

    names = docs.columns
    rows = per_text(docs, start, {"__masked": "string"})
    changed = {"text": F.col("__masked"), "n_chars": F.length("__masked").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names])
