"""Personal data in texts by a skip-chain conditional random field.

Tokens that hold a digit or an @, and capitalised words, are nodes, with a label each: outside, or the beginning or inside
of an e-mail address, phone number, IP address, card number, social security number, IBAN, person, organisation or place.
Words in lower case can't be of any of these kinds: they are observed, as context. Neighbours in the text share a
transition potential; and distant tokens that repeat each other or are similar (other separators, the same last seven
digits, a name and its genitive) share a skip potential, which favours equal labels: all copies by way of one node. Loopy
belief propagation passes messages along both until labels agree across each document: a bare number, or a name by itself,
is told by its copy that stands in a telling context.

A name is told by its context alone: capitalised words that no chain or skip leads from to a word of NAME_CUE can't be one.
So in a text without any word of NAME_CUE the capitalised words are outside, all of
them, and aren't made nodes: the same result, sooner.

The weights are trained here, by pseudo-likelihood, on token sequences made from the formats of each kind and of what is
mistaken for them: dates, versions, amounts, hashes, serial numbers, capitalised words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts, tune_arrow
from .simhash import merge

LABELS = ["O", "B-EMAIL", "B-PHONE", "I-PHONE", "B-IP", "B-CARD", "I-CARD", "B-SSN", "B-IBAN", "I-IBAN", "B-PERSON", "I-PERSON", "B-ORG", "I-ORG", "B-PLACE", "I-PLACE"]
N = len(LABELS)
NAMES = [k for k, x in enumerate(LABELS) if x[2:] in ("PERSON", "ORG", "PLACE")]
INSIDE = [k for k, x in enumerate(LABELS) if x[0] == "I"]
#: Nodes of the texts that are labelled together; a text with more is labelled by itself. A bound on memory alone.
GROUP_NODES = 20_000
#: Edges that messages are made of at a time.
GROUP_EDGES = 50_000
#: The share of a message that is new; messages are passed until none changes by more than TOLERANCE. ROUNDS only ends
#: those that swing for ever.
DAMPING, TOLERANCE, ROUNDS = 0.7, 1e-3, 2000
#: Characters of a normal form from which on equal tokens are linked.
LINKED_CHARS = 4
#: Longer numbers are linked by their last digits.
TAIL_DIGITS = 7
SEED = 65_537

_SEP = r"\s#$%&*!?,;\"'<>|{}\[\]=~^`\\"
_SEPARATOR = re.compile(f"[{_SEP}]")
_FROM_SIGN = re.compile(rf"[\d@][^{_SEP}]*")
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")
_PLAIN = re.compile(r"[^0-9a-z@]+")
_EMAIL = re.compile(r"[\w.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_OCTETS = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono", "whatsapp", "sms"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"},
    "ip": {"ip", "host", "server", "address", "addr", "client", "ping"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank"},
    "serial": {"version", "order", "serial", "invoice", "build", "release", "id", "ref", "ticket", "number", "section", "isbn", "price", "date"},
}
#: What tells names: the word before, or, before one of these prepositions and verbs, the one before that; or the word itself.
NAME_CUES = {
    "person": {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "monsieur", "madame", "señor", "señora", "dear", "name", "signed", "sincerely", "patient", "employee", "named"},
    "place": {"lives", "lived", "living", "born", "city", "town", "village", "resident", "residing", "moved", "wohnt", "geboren", "habite", "vive"},
    "org": {"works", "worked", "employed", "company", "firm", "employer", "arbeitet"},
}
_LINKS = {"is", "in", "of", "at", "for", "to", "by", "à", "en", "bei"}
_FIRMS = {"inc", "ltd", "llc", "gmbh", "corp", "corporation", "plc"}
NAME_CUE = re.compile(r"(?i)(?<!\w)(?:" + "|".join(sorted({*_FIRMS, *set().union(*NAME_CUES.values())})) + r")(?!\w)")
#: The same or more for the JVM, which takes letters by other tables: the part that only filters.
_NAME_CUE_JAVA = "(?iu)(?:" + "|".join(sorted({*_FIRMS, *set().union(*NAME_CUES.values())})) + ")"
_CAPITAL = re.compile(r"(?<![\w@])(?:[^\W\d_a-z][^\W\d_]+)(?:-[^\W\d_]+)?(?![\w@])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def nodes_of(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that hold a digit or an @, without what surrounds them."""
    out, at = [], 0
    for m in _FROM_SIGN.finditer(text):
        s, e = m.span()
        while s > at and not _SEPARATOR.match(text[s - 1]):
            s -= 1
        while e > s and text[e - 1] in ".:-/":
            e -= 1
        if text[e - 1] == ")" and "(" not in text[s:e]:
            e -= 1
        while s < e and (text[s] in ".:-/" or text[s] == "(" and ")" not in text[s:e]):
            s += 1
        at = m.end()
        if e > s and re.search(r"[\d@]", text[s:e]):
            out.append((s, e))
    return out


def _shape(token: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 20)};", token))
    return s if len(s) <= 24 else "long"


def token_features(token: str, before: str, after: str, near: tuple[str, str]) -> list[str]:
    """What is known of a node: its shape, whether checks hold, the words around it, its neighbours' shapes."""
    digits = re.sub(r"\D", "", token)
    shape = _shape(token)
    out = ["bias", f"shape={shape}", f"digits={min(len(digits), 20)}", f"left={near[0]}", f"right={near[1]}"]
    if _EMAIL.fullmatch(token):
        out.append("email")
    if _OCTETS.fullmatch(token):
        out.append("octets" if all(int(x) < 256 for x in token.split(".")) else "not octets")
    if digits and not re.search(r"[^\d\- ]", token):
        if 13 <= len(digits) <= 19:
            out.append("luhn" if luhn(digits) and digits[0] in "3456" else "not luhn")
        if len(digits) == 4 and shape == "94;":
            out.append("four")
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{0,30}", token):
        out.append("iban long" if len(token) >= 15 else "iban head")
    if re.search(r"[a-z]", token) and "@" not in token:
        out.append("letters")
    if token[0] == "+":
        out.append("plus")
    if token[0] == "(" and ")" in token:
        out.append("parens")
    for name, cue in CUES.items():
        if before in cue:
            out.append(f"after {name}")
        if after in cue:
            out.append(f"before {name}")
    return out


def names_of(text: str) -> list[tuple[int, int]]:
    """Places of the capitalised words; none in a text that no cue can tell of a name in."""
    return [m.span() for m in _CAPITAL.finditer(text) if m.group()[0].isupper() and m.group() != m.group().upper()] if NAME_CUE.search(text) else []


def name_features(text: str, s: int, e: int, near: tuple[bool, bool]) -> list[str]:
    token = text[s:e].lower()
    back = text[max(0, s - 40) : s].lower()
    start = not back.strip() or back.rstrip()[-1] in ".!?:;" or "\n" in back[len(back.rstrip()) :]
    two = re.findall(r"[^\W\d_]+", back)[-2:]
    before, second = ("", *two)[-1], two[0] if len(two) == 2 else ""
    # A title ends with a point, other words before a name don't.
    if start and not (back.rstrip().endswith(".") and before in NAME_CUES["person"]):
        before = second = ""
    follow = re.match(r",?\s{1,2}([^\W\d_]+)", text[e : e + 20])
    out = ["name", f"name left={near[0]}", f"name right={near[1]}", f"name start={start}"]
    cues = [k for k, own in NAME_CUES.items() if before in own or before in _LINKS and second in own]
    out += [f"name after {k}" for k in cues] or ["name after nothing"]
    if token in _FIRMS:
        out.append("name is firm")
    elif follow and follow.group(1).lower() in _FIRMS:
        out.append("name before firm")
    if any(token in own for own in NAME_CUES.values()):
        out.append("name is cue")
    return out


def _normal(token: str, name: bool) -> str:
    """What tokens that are linked have in common."""
    if name:
        return "name " + token.lower().removesuffix("s")
    plain = _PLAIN.sub("", token.lower())
    return plain[-TAIL_DIGITS:] if plain.isdigit() and len(plain) > TAIL_DIGITS else plain


class Graph:
    """The nodes of some texts, and the edges of both kinds. Features go to encode, some thousand nodes at a time, or are
    kept where there is none."""

    def __init__(self, encode: Callable[[list[list[str]]], np.ndarray] | None = None) -> None:
        self.encode = encode
        self.encoded: list[np.ndarray] = []
        self.places: list[tuple[int, int, int]] = []
        self.features: list[list[str]] = []
        self.told = bytearray()  # whether a cue stands by the node; numbers need none
        self.chain: list[int] = []
        self.copies: list[list[int]] = []

    def add(self, which: int, text: str) -> None:
        names = names_of(text)
        spans = nodes_of(text)
        if names:
            held = {s for s, _ in spans}
            spans = sorted([*spans, *(x for x in names if x[0] not in held)])
        named = set(names)
        first = len(self.places)
        shapes = ["" if x in named else _shape(text[x[0] : x[1]]) for x in spans]
        joined = [e2 - e1 <= 3 and (not shapes[i]) == (not shapes[i + 1]) and e2 >= e1 and not re.search(r"[\w\n]" if shapes[i] else r"[^ ]", text[e1:e2]) for i, ((_, e1), (e2, _)) in enumerate(zip(spans, spans[1:]))]
        alike: dict[str, list[int]] = {}
        for i, (s, e) in enumerate(spans):
            plain = _normal(text[s:e], not shapes[i])
            if len(plain) >= LINKED_CHARS:
                alike.setdefault(plain, []).append(first + i)
        copied = {i for c in alike.values() if len(c) > 1 for i in c}
        for i, (s, e) in enumerate(spans):
            token = text[s:e]
            beside = (i > 0 and joined[i - 1], i + 1 < len(spans) and joined[i])
            if not shapes[i]:
                fs = name_features(text, s, e, beside)
                self.told.append("name after nothing" not in fs or "name before firm" in fs or "name is firm" in fs)
                self.features.append(fs + ["name copied"] * (first + i in copied))
            else:
                self.told.append(1)
                word = _LAST_WORD.search(text[max(0, s - 40) : s])
                follow = re.match(r"[^\w]*([^\W\d_]+)", text[e : e + 40])
                near = (shapes[i - 1] if beside[0] else "", shapes[i + 1] if beside[1] else "")
                self.features.append(token_features(token, word.group(1).lower() if word else "", follow.group(1).lower() if follow else "", near))
            if self.encode and len(self.features) >= 4096:
                self.flush()
            self.places.append((which, s, e))
            if beside[0]:
                self.chain.append(first + i - 1)
        self.copies += [c for c in alike.values() if len(c) > 1]

    def flush(self) -> None:
        if self.encode and self.features:
            self.encoded.append(self.encode(self.features))
            self.features = []

    def unary(self) -> np.ndarray:
        self.flush()
        return np.concatenate(self.encoded) if self.encoded else np.zeros((0, N))


class SkipChainModel:
    def __init__(self, index: dict[str, int], node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.index, self.node, self.chain, self.skip = index, node, chain, skip
        # Such that two links by way of a shared node are as strong as one link between two copies.
        s = np.exp(max(skip[0, 0], 0.0))
        self.hub = np.log(s + np.sqrt(s * s + s * (N - 2) - (N - 1))) * np.eye(N)

    def unary(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), N))
        rows, at = [], []
        for i, fs in enumerate(features):
            for f in fs:
                if (j := self.index.get(f)) is not None:
                    rows.append(i)
                    at.append(j)
        if rows:
            np.add.at(out, rows, self.node[at])
        return out

    def factors(self, g: Graph) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Potentials of the nodes, and (left, right, potential) of each kind of edge; one potential for all of a kind."""
        unary = g.unary()
        opens = np.ones(len(unary), bool)
        opens[np.array(g.chain, np.int64) + 1] = False
        unary[np.ix_(opens, INSIDE)] -= 20
        # Two copies share a link. More share a node of their own, which each is linked to: two steps between any two.
        skip = [(c[0], c[1]) for c in g.copies if len(c) == 2]
        more = [c for c in g.copies if len(c) > 2]
        hubs = [(i, len(unary) + k) for k, c in enumerate(more) for i in c]
        kinds = [([(i, i + 1) for i in g.chain], self.chain), (skip, self.skip), (hubs, self.hub)]
        edges = [(*np.array(x, np.int64).reshape(-1, 2).T, pot) for x, pot in kinds if x]
        told = np.frombuffer(bytes(g.told), bool)
        if not told.all():
            root = np.arange(len(unary) + len(more))
            for a, b, _ in edges:
                merge(root, a, b)
            reached = np.zeros(len(root), bool)
            reached[root[: len(told)][told]] = True
            unary[np.ix_(~reached[root[: len(told)]], NAMES)] -= 50
        return np.concatenate([unary, np.zeros((len(more), N))]), edges

    def beliefs(self, g: Graph) -> np.ndarray:
        """Of each node the log-probabilities of its labels, up to a constant, by loopy belief propagation.

        An edge is worked on as long as what reaches its ends changes; so what has converged costs nothing."""
        belief, edges = self.factors(g)
        sent = [(np.zeros((len(a), N), np.float32), np.zeros((len(a), N), np.float32)) for a, *_ in edges]
        changed = np.ones(len(belief), bool)
        for _ in range(ROUNDS):
            before, changed = changed, np.zeros(len(belief), bool)
            delta: list[tuple[np.ndarray, np.ndarray]] = []
            for (a, b, pot), (to_b, to_a) in zip(edges, sent):
                active = np.flatnonzero(before[a] | before[b])
                for k in range(0, len(active), GROUP_EDGES):
                    own = active[k : k + GROUP_EDGES]
                    for start, end, out, back, matrix in ((a, b, to_b, to_a, pot), (b, a, to_a, to_b, pot.T)):
                        new = _pass_on(belief[start[own]] - back[own], np.exp(matrix)) - out[own]
                        large = np.abs(new).max(axis=1) > TOLERANCE
                        if large.any():
                            delta.append((out, own[large], end[own[large]], (DAMPING * new[large]).astype(np.float32)))
            if not delta:
                break
            for out, rows, ends, step in delta:  # all messages of a round are made of those of the round before
                out[rows] += step
                np.add.at(belief, ends, step)
                changed[ends] = True
        return belief[: len(g.places)]

    def label(self, g: Graph) -> np.ndarray:
        return self.beliefs(g).argmax(axis=1)

    def scan(self, found: list[str | None]) -> list[tuple[int, str, int, int]]:
        """(number of the text, kind, start, end) of what is found, in order."""
        out: list[tuple[int, str, int, int]] = []
        g = Graph(self.unary)
        for i, t in enumerate(found):
            if t:
                g.add(i, t)
            if len(g.places) > GROUP_NODES:
                out += self._things(g)
                g = Graph(self.unary)
        return out + self._things(g)

    def _things(self, g: Graph) -> list[tuple[int, str, int, int]]:
        if not g.places:
            return []
        chained = set(g.chain)
        out: list[list] = []
        before = -1
        labels = self.label(g)
        for i in np.flatnonzero(labels).tolist():
            (which, s, e), label = g.places[i], LABELS[labels[i]]
            kind = label[2:]
            if label[0] == "I" and before == i - 1 and i - 1 in chained and out[-1][1] == kind:
                out[-1][3] = e
            else:
                out.append([which, kind, s, e])
            before = i
        return [tuple(x) for x in out]


def _pass_on(x: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """The logs of the messages of rows of logs through a matrix of potentials; the largest of each row is 0."""
    out = np.log(np.exp(x - x.max(axis=1, keepdims=True)) @ potential)
    return out - out.max(axis=1, keepdims=True)


_CUE_WORDS = set().union(*NAME_CUES.values())


def training_texts(rng: np.random.Generator, n: int = 1600) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts and (start, end, label) of their tokens that aren't outside."""
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("abcdefghijklmnoprstuvwz") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        c = pick(["4", "51", "37", "6011", "55"])
        c += d((15 if c == "37" else 16) - 1 - len(c))
        return next(c + str(x) for x in range(10) if luhn(c + str(x)))

    def kinds(k: str) -> list[tuple[str, str]]:
        if k == "email":
            return [(f"{word()}{pick(['', '.', '_', '.'])}{pick(['', d(2), word()])}@{word()}{pick(['', d(1)])}.{pick(['com', 'org', 'example.com', 'co.uk', 'de'])}", "B-EMAIL")]
        if k == "phone":
            f = int(rng.integers(6))
            parts = [["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(2), d(4), d(4)], [f"+1-{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(3), d(7)]][f]
            return [(p, "B-PHONE" if i == 0 else "I-PHONE") for i, p in enumerate(parts)]
        if k == "ip":
            return [(".".join(str(x) for x in rng.integers(0, pick([256, 256, 20]), 4)), "B-IP")]
        if k == "card":
            c = card()
            if len(c) == 16 and rng.random() < 0.3:
                return [(c[i : i + 4], "B-CARD" if i == 0 else "I-CARD") for i in range(0, 16, 4)]
            return [("-".join(c[i : i + 4] for i in range(0, 16, 4)) if len(c) == 16 and rng.random() < 0.2 else c, "B-CARD")]
        if k == "ssn":
            return [(f"{d(3)}-{d(2)}-{d(4)}", "B-SSN")]
        if k == "iban":
            body = pick(["DE", "FR", "ES", "GB"]) + d(20)
            if rng.random() < 0.5:
                return [(body[i : i + 4], "B-IBAN" if i == 0 else "I-IBAN") for i in range(0, len(body), 4)]
            return [(body, "B-IBAN")]
        if k in ("person", "place", "org"):
            parts = [word().title() for _ in range(int(rng.integers(1, 3)))]
            return [(p, f"{'I' if i else 'B'}-{k.upper()}") for i, p in enumerate(parts)]
        bad = next(x for x in iter(lambda: d(16), "") if not luhn(x))
        hexed = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(16, 41))))
        none = [d(int(rng.integers(1, 13))), f"{rng.integers(1900, 2030)}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"{rng.integers(1900, 2030)}-{d(2)}-{d(2)}", f"{d(3)}.{d(2)}", hexed, bad, f"{word()}{d(2)}", f"@{word()}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(3)}", f"{rng.integers(256, 999)}.{d(3)}.{d(2)}.{d(1)}", f"{d(2)}.{d(2)}.{rng.integers(1900, 2030)}", f"AKIA{d(2)}{word().upper()}{d(3)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"{d(10)}.{d(3)}", f"{d(3)}-{d(4)}", f"{word()}/{d(2)}/{d(3)}", f"({d(1)})", f"{d(2)}%"]
        return [(pick(none), "O")]

    out = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        plain_names: list[str] = []
        kept, inner = None, set()  # inner: places after which a thing goes on
        for _ in range(int(rng.integers(2, 7))):
            for _ in range(int(rng.integers(1, 5))):
                if rng.random() < 0.15:  # a capitalised word, now and then again
                    plain_names.append(word().title())
                    parts.append((pick(plain_names), "O"))
                else:
                    parts.append((word(), "O"))
                if rng.random() < 0.1:
                    parts += [(pick(["is", "in", "of", "at", "for", "to", "by"]), "O")]
            k = pick(["email", "phone", "ip", "card", "ssn", "iban", "person", "place", "org", "none", "none", "none", "none", "none"])
            if rng.random() < 0.35:
                cue = {"none": "serial"}.get(k, k)
                if cue in CUES:
                    parts.append((pick(sorted(CUES[cue])), "O"))
            if rng.random() < 0.1:  # a run of capitalised words that names nothing
                parts += [(word().title(), "O") for _ in range(int(rng.integers(2, 6)))]
                parts.append((word(), "O"))
            new = kept is None or rng.random() > (0.6 if kept[0][1] in ("B-PERSON", "B-ORG", "B-PLACE") else 0.25)
            made = kinds(k) if new else kept
            if not new and made[0][1] in ("B-PERSON", "B-ORG", "B-PLACE") and rng.random() < 0.5:
                made = made[:1]
            kept = made
            if new and k in NAME_CUES and k != "org" or new and k == "org" and rng.random() < 0.5:
                cue = pick(sorted(NAME_CUES[k]))
                if k == "person" and rng.random() < 0.25:
                    parts.append((pick(["Dear", "patient", "Employee", "signed"]), "O"))
                parts.append((cue.title() if rng.random() < 0.3 else cue, "O"))
                if k != "person" or cue == "name":
                    parts.append((pick(["in", "of", "is", "at", "for"]), "O"))
                elif rng.random() < 0.3:
                    parts[-1] = (cue.title() + ".", "O")
            elif new and k == "org":
                made = [*made, (pick(["Inc", "Ltd", "GmbH", "Corp", "LLC", "Plc"]), "I-ORG")]
            inner.update(range(len(parts), len(parts) + len(made) - 1))
            parts += made
            if rng.random() < 0.15:
                more = kinds(pick(["email", "ip", "card", "none"]))
                inner.update(range(len(parts), len(parts) + len(more) - 1))
                parts += more
        text, marks = "", []
        for i, (w, y) in enumerate(parts):
            s = len(text)
            text += w
            if y != "O":
                marks.append((s, s + len(w), y))
            text += " " if i in inner or y == "O" and (w.lower().rstrip(".") in _CUE_WORDS or w in _LINKS) else pick(["", "", "", "", "", ".", ",", "###", "$$$", "%%%", "&&&", "!!"]) + " "
        out.append((text, marks))
    return out


@lru_cache(maxsize=1)
def pii_model(seed: int = SEED) -> SkipChainModel:
    """Weights by pseudo-likelihood: each node given its neighbours' labels, on chains and on skips."""
    g, y = Graph(), []
    for i, (text, marks) in enumerate(training_texts(np.random.default_rng(seed))):
        g.add(i, text)
        known = {s: label for s, _, label in marks}
        y += [LABELS.index(known.get(s, "O")) for _, s, _ in g.places[len(y) :]]
    y = np.array(y)
    eye = np.eye(N)
    index: dict[str, int] = {}
    rows, at = [], []
    for i, fs in enumerate(g.features):
        for f in fs:
            rows.append(i)
            at.append(index.setdefault(f, len(index)))
    own = np.zeros((len(y), len(index)), np.float32)
    own[rows, at] = 1
    left, right, kin = np.zeros((len(y), N)), np.zeros((len(y), N)), np.zeros((len(y), N))
    c = np.array(g.chain)
    left[c + 1], right[c] = eye[y[c]], eye[y[c + 1]]
    for a, b in (x for c in g.copies for x in zip(c, c[1:])):
        kin[a] += eye[y[b]]
        kin[b] += eye[y[a]]
    node, chain, skip = np.zeros((len(index), N), np.float32), np.zeros((N, N)), 0.0
    grads = [np.zeros_like(node), np.zeros_like(chain), 0.0]
    for _ in range(200):
        z = own @ node + left @ chain + right @ chain.T + skip * kin
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - eye[y]) / len(y)
        now = own.T @ p.astype(np.float32) + 1e-5 * node, left.T @ p + (right.T @ p).T + 1e-4 * chain, float((kin * p).sum()) + 1e-4 * skip
        grads = [a + b**2 for a, b in zip(grads, now)]  # adaptive steps: rare features learn as fast as common ones
        node -= (0.5 * now[0] / (np.sqrt(grads[0]) + 1e-8)).astype(np.float32)
        chain -= 0.3 * now[1] / (np.sqrt(grads[1]) + 1e-8)
        skip -= 0.5 * now[2] / (np.sqrt(grads[2]) + 1e-8)
    return SkipChainModel(index, node.astype(float), chain, skip * np.eye(N))


def find_pii(docs: DataFrame, model: SkipChainModel | None = None) -> DataFrame:
    """(doc_id, label, start, end, value) for each piece of personal data; places are in characters of the text.

    Each row is a document by itself, so repeated rows give repeated results and a null doc_id is kept. A null or empty
    text, or one without digit, @ and name cue, has none. The copies of a token share one node that each is linked to, so
    a text of any number of copies has as many links; a text of any length is labelled whole, in memory of some hundred
    bytes a node. An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or pii_model())
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hits = [(ids[i], kind, s, e, found[i][s:e]) for i, kind, s, e in sent.value.scan(found)]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*hits), kinds)], ["doc_id", "label", "start", "end", "value"])

    tune_arrow(spark)
    return texts(docs).where(F.col("text").rlike("[0-9@]") | F.col("text").rlike(_NAME_CUE_JAVA)).mapInArrow(search, "doc_id long, label string, start long, end long, value string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
