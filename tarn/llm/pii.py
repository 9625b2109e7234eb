"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained by maximum likelihood from a small labelled table and decoded by Viterbi in numpy. A text is one
sequence of all its tokens. Most tokens of prose are outside on every best path, which their own and the next token's weights
prove (`surely_outside`); such tokens part the sequence, and Viterbi runs over what lies between, many pieces at a time. The
tags are those of Viterbi over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common as C

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner tag of each kind

# The patterns as they are scanned for: in time linear in a text, whatever it holds. A match of the first ones can't begin inside
# a run of its own first characters, and giving back what a run took never helps; so runs are taken whole.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMERIC = re.compile(r"[0-9+(][0-9\x20().+-]*")  # every match of the last three lies inside one of these
_AT, _DOT = r"(?:@|(?<![A-Za-z])at(?![A-Za-z]))", r"(?:\.|(?<![A-Za-z])dot(?![A-Za-z]))"
_SPELLED = re.compile(rf"(?>.*?\w)(?>.*?{_AT})(?>.*?\w)(?>.*?{_DOT}).*?\w", re.I | re.S)  # an added address: a name at a name dot a name
_BASE = re.compile(r"[0-9@]")  # no base span without one of these


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([x for x in text if "0" <= x <= "9"])


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    return 12 <= len(d := _digits(text)) <= 19 and luhn(d)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, leftmost and non-overlapping in each kind, those that fail dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        domain = _DOMAIN.match(text, at + 1) if a < at else None
        if domain:
            end = domain.end()
            out.append((a, 0, end))
        at = text.find("@", max(at + 1, end))
    for run in _NUMERIC.finditer(text):
        a, part = run.start(), run.group()
        if len(part) < 7:
            continue
        for kind, pattern, right in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            out += [(a + m.start(), kind, a + m.end()) for m in pattern.finditer(part) if right(m.group())]
    return sorted(out)


# --- word shapes --------------------------------------------------------------------------------------------------

#: Domain words and separators that obfuscated addresses use.
_WORDS = {"at": 1, "dot": 2, "com": 3, "org": 3, "net": 3, "edu": 3, "tel": 4, "phone": 4, "call": 4, "fax": 4, "mobile": 4, "card": 5, "visa": 5, "ip": 6, "host": 6, "server": 6, "mail": 7, "email": 7, "contact": 7, "version": 8, "token": 8}
_MARKS = {x: k for k, x in enumerate("@.-+()[]<>:,/_%#=\"'")}
SHAPES = 64


#: Classes of code points (blank, letter, digit, any other), places of marks, and the cue words as numbers of base 256.
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_CLASSES = np.array([_BLANK if chr(c).isspace() else _OTHER for c in range(0x3001)] + [_OTHER], np.uint8)
_CLASSES[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASSES[48:58] = _DIGIT
_MARK = np.array([_MARKS.get(chr(c), len(_MARKS)) for c in range(128)] + [len(_MARKS)], np.int16)
_CUES = sorted((int.from_bytes(w.encode(), "little"), k) for w, k in _WORDS.items())
_CUE_KEYS, _CUE_KINDS = np.array([k for k, _ in _CUES], np.uint64), np.array([k for _, k in _CUES], np.int16)
_CUE_CHARS = max(map(len, _WORDS))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shape * 2 + space before, bounds) of the tokens of texts: text i has those from bounds[i] to bounds[i + 1].

    A token is a run of letters, a run of digits, or any other character but a blank. Its shape is a small number for its
    form: length of digits, case and length of letters, cue words, marks.
    """
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)))
    kind = _CLASSES[np.minimum(raw, 0x3001)]
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _OTHER)
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    of = kind[starts] if len(starts) else kind
    told = of != _BLANK
    starts, ends, of = starts[told], ends[told], of[told]
    size, first = ends - starts, raw[starts]
    shapes = 37 + _MARK[np.minimum(first, 128)]
    shapes[of == _DIGIT] = np.minimum(size[of == _DIGIT], 20)
    letters = np.flatnonzero(of == _LETTER)
    shapes[letters] = 29 + 2 * np.minimum(3, size[letters] // 3) + (first[letters] < 97)
    short = letters[size[letters] <= _CUE_CHARS]
    key = np.zeros(len(short), np.uint64)
    for k in range(_CUE_CHARS):
        more = size[short] > k
        key[more] |= (raw[starts[short[more]] + k] | 32).astype(np.uint64) << np.uint64(8 * k)
    at = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    cue = _CUE_KEYS[at] == key
    shapes[short[cue]] = 20 + _CUE_KINDS[at[cue]]
    bounds = np.searchsorted(starts, cuts)
    moved = np.repeat(cuts[:-1], np.diff(bounds))
    spaced = (kind[starts - 1] == _BLANK) & (starts > moved)
    return starts - moved, ends - moved, shapes.astype(np.int64) * 2 + spaced, bounds


# --- the field ----------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of shapes at -1, 0, +1 and +-2 tokens for each tag, and of tag pairs."""

    own: np.ndarray  # 5 x 2 SHAPES + 1 x TAGS
    pair: np.ndarray  # TAGS x TAGS, -inf where not allowed


def _pairs() -> np.ndarray:
    """An inner tag follows only its own first or inner tag."""
    allowed = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        allowed[:, 2 + 2 * k] = False
        allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return allowed


_PAD = 2 * SHAPES


def _context(x: np.ndarray) -> list[np.ndarray]:
    """x (sequences x steps, _PAD beyond the end) shifted by -2 to 2 steps."""
    n, t = x.shape
    wide = np.full((n, t + 4), _PAD, x.dtype)
    wide[:, 2:-2] = x
    return [wide[:, k : k + t] for k in range(5)]


def emissions(field: Field, x: np.ndarray) -> np.ndarray:
    return sum(field.own[k][c] for k, c in enumerate(_context(x)))


def viterbi(field: Field, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags of each padded sequence; of equal paths the one with the smaller tags, from the end."""
    n, t = x.shape
    flat = np.full((n, t + 4), _PAD)
    flat[:, 2:-2] = np.where(np.arange(t)[None, :] < lengths[:, None], x, _PAD)
    begin = np.where(_BEGINS, 0.0, -np.inf)[None, :].repeat(n, 0)
    found = best_tags(field, flat.ravel(), np.arange(n) * (t + 4) + 2, lengths, begin, np.zeros((n, TAGS)))
    tags = np.zeros((n, t), np.int8)
    tags[np.repeat(np.arange(n), lengths), C.ranges(np.zeros(n, np.int64), lengths)] = found
    return tags


_BEGINS = np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0  # tags that a sequence can begin with


def best_tags(field: Field, x: np.ndarray, first: np.ndarray, lengths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Viterbi over pieces of x (from first, so many steps each, two more shapes on both sides): the tags of all, piece after
    piece. begin and end are added at a piece's first and last step.

    The longest stand first, so that those which still go on are the first ones: a step costs by what goes on, and all pieces
    together take as many steps as the longest has.
    """
    order = np.argsort(-lengths, kind="stable")
    at, size = first[order], lengths[order]
    to = (np.cumsum(lengths) - lengths)[order]  # where a piece's tags go
    going = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
    own = field.own.reshape(-1, TAGS)
    near, which = np.arange(-2, 3), np.arange(5) * (2 * SHAPES + 1)
    pair = field.pair.T  # to x from, so that the maximum is over the last axis
    back, tags = np.zeros((int(size.sum()), TAGS), np.int8), np.zeros(int(size.sum()), np.int8)
    best = begin[order]
    for s, m in enumerate(going.tolist()):
        e = own[x[at[:m, None] + (near + s)] + which].sum(1)
        if s:
            way = best[:m, None, :] + pair
            back[to[:m] + s] = way.argmax(2)
            best[:m] = way.max(2) + e
        else:
            best += e
    now = (best + end[order]).argmax(1)
    for s in range(len(going) - 1, -1, -1):
        m = going[s]
        place = to[:m] + s
        tags[place] = now[:m]
        now[:m] = back[place, now[:m]]
    return tags


def surely_outside(field: Field, e: np.ndarray) -> np.ndarray:
    """Whether a token is outside on every best path, for tokens that follow each other, with the emissions of one more.

    A path with tag k there gains by tagging it outside, what precedes in the span staying and what follows becoming a span
    of its own; the gain is bounded from below over all neighbours that k may have. Tokens that don't pass are undecided.
    """
    p, spare = field.pair, 1e-6
    ends = [0, *range(1, TAGS, 2)]  # tags that may follow any tag
    out = np.ones(len(e) - 1, bool)
    for c in range(len(KINDS)):
        b, i = 1 + 2 * c, 2 + 2 * c
        again = e[1:, b] - e[1:, i] + min(0.0, (p[b, [*ends, i]] - p[i, [*ends, i]]).min())
        for k, before in ((b, range(TAGS)), (i, (b, i))):
            left = min(0.0 if k == b else np.inf, min(p[j, 0] - p[j, k] for j in before))
            last = min(0.0, (p[0, ends] - p[k, ends]).min())
            out &= e[:-1, 0] - e[:-1, k] + left + np.minimum(last, p[0, b] - p[k, i] + again) > spare
    return out


def fit_field(sequences: list[tuple[list[int], list[int]]], rounds: int = 150, ridge: float = 0.02) -> Field:
    """Maximum likelihood by forward-backward over all sequences of (shapes, tags) at once, with Adam."""
    n, t = len(sequences), max(len(x) for x, _ in sequences)
    x, y, lengths = np.full((n, t), _PAD), np.zeros((n, t), int), np.array([len(a) for a, _ in sequences])
    for i, (a, b) in enumerate(sequences):
        x[i, : len(a)], y[i, : len(b)] = a, b
    inside = np.arange(t)[None, :] < lengths[:, None]
    allowed = _pairs()
    field = Field(np.zeros((5, 2 * SHAPES + 1, TAGS)), np.where(allowed, 0.0, -1e9))
    context = _context(x)
    moments = [np.zeros_like(field.own), np.zeros_like(field.own), np.zeros_like(field.pair), np.zeros_like(field.pair)]

    flat = [c[inside] for c in context]
    for r in range(1, rounds + 1):
        e = emissions(field, x)
        e = np.exp(e - e.max(2, keepdims=True))
        e[:, 0, 2::2] = 0
        way = np.exp(field.pair)
        f, b, scale = np.empty_like(e), np.ones_like(e), np.ones((n, t, 1))
        for s in range(t):
            f[:, s] = (f[:, s - 1] @ way if s else 1) * e[:, s]
            scale[:, s] = f[:, s].sum(1, keepdims=True)
            f[:, s] /= scale[:, s]
            if s:
                f[:, s] = np.where(inside[:, s, None], f[:, s], f[:, s - 1])
        grad_pair = np.zeros_like(field.pair)
        for s in range(t - 2, -1, -1):
            on = inside[:, s + 1]
            step = np.where(on[:, None], b[:, s + 1] * e[:, s + 1] / scale[:, s + 1], 0)
            grad_pair += way * (f[:, s].T @ step)
            np.subtract.at(grad_pair, (y[on, s], y[on, s + 1]), 1)
            b[:, s] = np.where(on[:, None], step @ way.T, 1)
        share = f * b * inside[:, :, None]
        share[np.arange(n)[:, None], np.arange(t)[None, :], y] -= inside
        share = share[inside]
        grad_own = np.stack([np.stack([np.bincount(c, share[:, k], 2 * SHAPES + 1) for k in range(TAGS)], axis=1) for c in flat])
        for w, g, m, v in ((field.own, grad_own, *moments[:2]), (field.pair, grad_pair * allowed, *moments[2:])):
            g = (g + ridge * np.where(np.abs(w) < 1e8, w, 0)) / n
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return field


def labelled_table(spark: SparkSession, rows: int = 400) -> DataFrame:
    """The small labelled table: made-up lines (text, spans) with addresses in many spellings, and prose without any."""
    texts, spans = zip(*labelled_lines(rows), strict=True)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    return spark.createDataFrame(pa.table({"text": pa.array(texts, pa.string()), "spans": pa.array(spans, kind)}))  # rows would start workers of another kind


def labelled_lines(rows: int = 400) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("aeinorstlumd"), rng.integers(2, 9)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]

    def email():
        a, b, c = pick(word(), f"{word()}.{digits(2)}", f"{word()}{digits(1)}"), pick(word(), f"{word()}{digits(1)}"), pick("com", "org", "net", "example.com")
        return pick(f"{a}@{b}.{c}", f"{a} @ {b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a}@{b} dot {c}"), "email"

    def ip():
        p = [str(x) for x in rng.integers(0, 256, 4)]
        return pick(".".join(p), ".".join(p), " . ".join(p), "[.]".join(p)), "ip"

    def card():
        d = digits(15)
        d += next(x for x in "0123456789" if luhn(d + x))
        p = [d[k : k + 4] for k in range(0, 16, 4)]
        return pick("".join(p), " ".join(p), "-".join(p), ".".join(p)), "card"

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b} {c}", f"00{digits(2)} {a} {b} {c}"), "phone"

    def other():
        h = "".join(rng.choice(list("0123456789abcdef"), 40))
        return pick(f'token = "{h}"', f'"{h.upper()}"', f"version {digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.", f"{digits(4)}-{digits(2)}-{digits(2)}", digits(rng.integers(1, 8)), f"{digits(3)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}%", f"= {digits(3)} + {digits(2)}", f"({digits(4)})", f"{digits(2)}/{digits(2)}/{digits(4)}"), None

    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join([word() for _ in range(rng.integers(1, 6))]) + pick(" ", " ", ": ", ", ")
            made, kind = pick(email, ip, card, phone, other, other)()
            if kind:
                spans.append((len(text), len(text) + len(made), kind))
            text += made + pick(" ", ". ", ", ", "### ", "!! ")
        out.append((text + word(), spans))
    for k, text in enumerate(_prose_lines(rows)):
        made, kind = pick(email, ip, card, phone)() if k % 2 else ("", None)
        spans = [(len(text), len(text) + len(made), kind)] if kind else []
        out.append((text + made + (pick("\n", " ", ". ", ".\n") + out[-1][0] if kind and not out[-1][1] else ""), spans))
    return out


def _prose_lines(rows: int) -> list[str]:
    """Made-up prose without addresses, but with the words and marks that addresses are spelled with."""
    rng = np.random.default_rng(11)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(rng.choice(list("aeinorstlumdhwgé"), rng.integers(1, 12)))
    out = []
    for _ in range(rows):
        text = ""
        for _ in range(rng.integers(1, 6)):
            words = [pick(word(), word(), word(), word(), "at", "that", "dot", "of", "the", "mail", "call") for _ in range(rng.integers(1, 10))]
            words[0] = words[0].capitalize()
            for k in range(1, len(words)):
                text += words[k - 1] + pick(" ", " ", " ", " ", " ", " ", ", ", "\n", " | ", " (", ") ", "-", ": ", " [")
            text += words[-1] + pick(". ", ". ", ".\n", "? ", ".", "\n", " | ")
        out.append(text)
    return out


def train(table: DataFrame) -> Field:
    """Fit the field to a labelled table (text, spans): it is small by contract and comes to the driver."""
    rows = [(text or "", spans or []) for text, spans in table.select("text", "spans").collect()]
    starts, _, kinds, bounds = tokens([text for text, _ in rows])
    sequences = []
    for (_, spans), a, b in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tags = []
        for at in starts[a:b].tolist():
            own = next((s for s in spans if s[0] <= at < s[1]), None)
            tags.append(0 if own is None else 1 + 2 * KINDS.index(own[2]) + (bool(tags) and at != own[0] and tags[-1] > 0))
        if tags:
            sequences.append((kinds[a:b].tolist(), tags))
    return fit_field(sequences)


def _plausible(kind: int, text: str) -> bool:
    """What an added span must have, so that a shape alone never convicts clean text."""
    d = _digits(text)
    if kind == 0:
        return len(text) >= 6 and _SPELLED.match(text) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


_BLOCK = 1 << 16  # tokens whose emissions are held at once
_TOKENS = 1 << 20  # undecided ones that are decoded together, unless a piece has more


def _undecided(field: Field, x: np.ndarray) -> np.ndarray:
    """Whether a token is not surely outside; x has the texts' shapes with two _PAD before, between and after them."""
    out = np.zeros(len(x), bool)
    for a in range(2, len(x) - 2, _BLOCK):
        b = min(a + _BLOCK, len(x) - 2)
        e = sum(field.own[k][x[a + k - 2 : b + k - 1]] for k in range(5)) if b < len(x) - 2 else emissions(field, x[None, a - 2 :])[0, 2:-1]
        out[a:b] = ~surely_outside(field, e)
    return out & (x != _PAD)


def find_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; an added span overlaps no base span."""
    added: list[list] = [[] for _ in texts]
    starts, ends, kinds, bounds = tokens(texts)
    place = np.arange(len(starts)) + 2 * np.repeat(np.arange(1, len(texts) + 1), np.diff(bounds))
    x = np.full(len(starts) + 2 * len(texts) + 2, _PAD)
    x[place] = kinds
    open_ = np.concatenate(([False], _undecided(field, x), [False]))
    first, after = np.flatnonzero(open_[1:] & ~open_[:-1]), np.flatnonzero(open_[:-1] & ~open_[1:])
    size = after - first
    begins, free = np.where(_BEGINS, 0.0, -np.inf), np.zeros(TAGS)
    cuts = [0, *np.flatnonzero(np.diff(np.cumsum(size) // _TOKENS)).tolist(), len(size)] if len(size) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        a, lengths = first[i:j], size[i:j]
        begin = np.where((x[a - 1] == _PAD)[:, None], begins, field.pair[0])
        end = np.where((x[a + lengths] == _PAD)[:, None], free, field.pair[:, 0])
        tags = best_tags(field, x, a, lengths, begin, end)
        at = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(tags))  # the tags' places in x
        starting = np.flatnonzero(tags % 2 == 1)
        token = np.searchsorted(place, at[starting])
        of = np.searchsorted(bounds, token, "right") - 1
        last = np.repeat(np.cumsum(lengths), lengths)  # where each tag's piece ends
        for k, t, doc in zip(starting.tolist(), token.tolist(), of.tolist(), strict=True):
            stop, inner = k + 1, tags[k] + 1
            while stop < last[k] and tags[stop] == inner:
                stop += 1
            added[doc].append((int(starts[t]), int(tags[k] // 2), int(ends[t + stop - k - 1])))
    out = []
    for text, extra in zip(texts, added, strict=True):
        base = base_spans(text) if _BASE.search(text) else []
        alone = lambda a, b, text=text: not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
        more = [x for x in extra if alone(x[0], x[2]) and all(x[2] <= b[0] or x[0] >= b[2] for b in base) and _plausible(x[1], text[x[0] : x[2]])]
        out.append((base, sorted(base + more)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the kind of its first, in brackets."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def detect(docs: DataFrame, field: Field | None = None, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of them), spans (all, as kind:start:end joined by
    commas, in code points) and, if asked, `redacted`, the text without them.

    Whole texts are read; null reads as empty: no spans, and redacted null. All rows and columns stay; columns with the
    names of new ones are replaced. A field may be given, else one is trained from labelled_table().
    """
    held = C.unused(docs, "_pii")
    names = [x.split()[0] for x in _FOUND.split(", ")]
    found = docs.withColumn(held, _found(docs, field, text_col, redact))
    return found.withColumns({n: F.col(f"{held}.{n}") for n in names if redact or n != "redacted"}).drop(held)


def without_personal_data(docs: DataFrame, field: Field | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with all spans of detect() replaced in their texts by the kinds' names, and length_col, if given, by the texts' new
    lengths. All rows and all other columns stay as they are, whatever they are called."""
    held = C.unused(docs, "_pii")
    out = docs.withColumn(held, _found(docs, field, text_col, True)).withColumn(text_col, F.col(f"{held}.redacted"))
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.drop(held)


def _found(docs: DataFrame, field: Field | None, text_col: str, redact: bool):
    """The struct column of what detect() finds."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    sent = spark.sparkContext.broadcast(field or train(labelled_table(spark)))

    import pandas as pd
    from collections.abc import Iterator

    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(columns):
        for column in columns:
            out = np.empty((len(column), len(names)), object)
            values = column.tolist()
            texts = [x or "" for x in values]
            cuts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)))
            spans = [s for i, j in C.slices(cuts) for s in find_spans(texts[i:j], sent.value)]
            for k, (x, (base, every)) in enumerate(zip(values, spans, strict=True)):
                counts = [0] * len(KINDS)
                for s in base:
                    counts[s[1]] += 1
                out[k] = [*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), redacted(x, every) if redact and x is not None else None]
            yield pd.DataFrame(out, columns=names)
        C.tidy()

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, _FOUND)(F.col(text_col).cast("string"))
