"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans of whole texts, in time linear in the text.  The field then labels the
tokens that hold a digit or an at sign.  Its factors are token features, a factor between neighbouring
tokens, and skip factors between distant tokens that repeat or resemble each other (same letters and
digits, same last digits, or same beginning of an address), so that a number spelled in full once is also
known where it is shortened.  A token that resembles one in a base span hears from it directly, however many
lie between; of others, three or more that resemble each other share one variable.  Marginals come from
loopy sum-product messages over each document's tokens, passed until they settle.  Weights are fitted by
pseudo-likelihood on the same graph of generated, labelled sentences in four languages; the seed and their
number are parameters.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import id_and_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
PLAIN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
EDGE = ".,;:!?\"'`<>[]{}|*#&$%"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern: each at sign with the whole run of address characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in PLAIN:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches that pass their checks, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Places of tokens with a digit or an at sign, without punctuation around them."""
    out = []
    for m in TOKEN.finditer(text):
        bare = m[0].rstrip(EDGE)
        begin = m.start() + len(bare) - len(bare.lstrip(EDGE))
        if begin < m.start() + len(bare):
            out.append((begin, m.start() + len(bare)))
    return out


CUES = {
    "mail": 1, "email": 1, "e-mail": 1, "correo": 1, "courriel": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "serveur": 2, "servidor": 2, "card": 3, "visa": 3, "credit": 3, "karte": 3, "carte": 3, "tarjeta": 3,
    "phone": 4, "tel": 4, "call": 4, "mobile": 4, "fax": 4, "number": 4, "dial": 4, "telefon": 4, "handy": 4, "ruf": 4, "rufen": 4, "mobil": 4, "rufnummer": 4, "téléphone": 4, "appelez": 4, "portable": 4, "numéro": 4, "teléfono": 4, "llame": 4, "llama": 4, "móvil": 4, "número": 4,
}
FILLER = [
    "we will meet at the old house near river and then write about it again for a while in".split(), "wir treffen uns am alten haus und dann schreiben wir noch einmal über den fluss oder nicht um".split(),
    "nous allons à la vieille maison près de la rivière et puis on écrit encore une fois pour voir en".split(), "nos vemos en la casa vieja cerca del río y luego escribimos otra vez sobre eso un rato a las".split(),
]
#: Words before a number that is no one's.
COUNTED = "order invoice page chapter version in since rechnung seite nr kapitel seit facture depuis chapitre factura página desde capítulo room zimmer no".split()
N_FEATURES = 32


def features(text: str, begin: int, end: int, base: int) -> np.ndarray:
    """What a token shows by itself and its left context; ``base`` is the label that a pattern gave it."""
    token = text[begin:end]
    digits = sum(c in "0123456789" for c in token)
    before = text[max(0, begin - 24) : begin].lower().split()
    cue = next((CUES[w.strip(EDGE)] for w in reversed(before[-2:]) if w.strip(EDGE) in CUES), 0)
    out = np.zeros(N_FEATURES)
    out[0] = 1
    out[base + 1 if base else 0] = 1
    out[6 + min(digits, 16) // 4] = 1
    out[11] = "@" in token
    out[12] = token.count(".") == 3
    out[13] = token.count(".") in (1, 2)
    out[14] = "-" in token
    out[15] = "(" in token or ")" in token
    out[16] = "+" in token
    out[17] = digits == len(token)
    out[18] = any(c.isalpha() for c in token)
    out[19 + cue] = 1
    out[24] = len(token) > 24
    out[25] = digits == 0
    after = text[end : end + 4].split()[:1]
    out[26] = bool(after) and after[0][:1] in DIGITS and text[end : end + 1] == " "
    out[27] = bool(before) and all(c in "0123456789()+/-." for c in before[-1]) and text[begin - 1 : begin] == " "
    out[28] = "/" in token
    out[29] = token[:1] == "0" and digits > 1
    out[30] = bool(before) and before[-1].strip(EDGE) in COUNTED
    out[31] = re.fullmatch(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|[0-9]{3}-[0-9]{4}", token) is not None
    return out


def keys_of(token: str) -> str:
    """What a token shares with those that resemble it: an address's beginning, else its last seven digits, else its letters and digits."""
    if "@" in token[1:]:
        user, _, host = token.lower().partition("@")
        return f"@{user}@{host.split('.')[0]}" if host else ""
    digits = re.sub("[^0-9]", "", token)
    if len(digits) >= 7:
        return digits[-7:]
    same = re.sub(r"[\W_]", "", token.lower())
    return "=" + same if len(same) >= 6 else ""


def shared_keys(keys: list[str]) -> list[list[int]]:
    """Groups of tokens that repeat or resemble each other."""
    groups: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        if key:
            groups.setdefault(key, []).append(i)
    return [g for g in groups.values() if len(g) > 1]


class SkipChain:
    """Weights of unary, chain and skip factors, and loopy inference.

    ``half`` is the factor between a token and its group's variable; two of them in a row are the skip factor, so pairs,
    groups and base spans are tied by one and the same weights.
    """

    def __init__(self, unary: np.ndarray, chain: np.ndarray, half: np.ndarray):
        self.unary, self.chain, self.half = unary, chain, half
        self.skip = np.log(np.exp(half) @ np.exp(half))

    @classmethod
    def of_skip(cls, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> SkipChain:
        """With the half factor whose square comes near the skip factor."""
        size, turn = np.linalg.eigh(np.exp(skip))
        return cls(unary, chain, np.log(np.maximum(turn * np.sqrt(np.maximum(size, 0)) @ turn.T, 1e-6)))

    def marginals(self, shown: np.ndarray, links: list[tuple[int, int]], groups: list[list[int]], rounds: int = 1000, near: float = 1e-5) -> np.ndarray:
        """Label marginals by damped sum-product messages along links of neighbours and within groups.

        Labels of base spans are known to their groups.  Messages pass until none changes by more than ``near``; ``rounds`` only ends those that never settle.
        """
        local = shown @ self.unary
        n, based = len(local), shown[:, 2:6].any(1)
        for g in groups:
            known = {int(shown[i, 2:6].argmax()) + 1 for i in g if based[i]}
            for i in g if known else ():
                if not based[i]:
                    local[i] += self.skip[sorted(known)].sum(0)
        open_ones = [g for g in groups if not based[g].any()]
        skips, large = [tuple(g) for g in open_ones if len(g) == 2], [g for g in open_ones if len(g) > 2]
        hubs = [(i, n + k) for k, g in enumerate(large) for i in g]
        pairs = [*links, *skips, *hubs]
        if not pairs:
            return _softmax(local)
        local = np.concatenate([local, np.zeros((len(large), len(LABELS)))])
        a, b = np.array(pairs).T
        factor = np.concatenate([np.repeat(f[None], k, 0) for f, k in ((self.chain, len(links)), (self.skip, len(skips)), (self.half, len(hubs)))])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])  # message s->t: factor[s label, t label]
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = _logsum(out[:, :, None] + factor)
            new -= new.max(1, keepdims=True)
            settled = np.abs(new - message).max() <= near
            message = 0.5 * message + 0.5 * new
            if settled:
                break
        belief = local.copy()
        np.add.at(belief, target, message)
        return _softmax(belief[:n])


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def phone_forms(rng: random.Random) -> tuple[str, list[str], list[str]]:
    """A number in full, ways to write it without the country, and ways to shorten it; of one country."""
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    country = rng.choice(["us", "us", "de", "fr", "es"])
    if country == "us":
        area, a, b = rng.choice("23456789") + digits(2), digits(3), digits(4)
        return rng.choice([f"+1-{area}-{a}-{b}", f"+1{area}{a}{b}", f"+1 {area} {a} {b}", f"+1 ({area}) {a}-{b}"]), [f"{area}-{a}-{b}", f"({area}) {a}-{b}", f"{area}.{a}.{b}"], [f"{a}-{b}", f"{a}{b}"]
    if country == "de":
        area, n = rng.choice(["30", "89", "40", "221", "711", "170"]), rng.choice("123456789") + digits(6)
        return rng.choice([f"+49 {area} {n}", f"+49{area}{n}", f"+49-{area}-{n}"]), [f"0{area}/{n}", f"(0{area}) {n}", f"0{area} {n}", f"0{area}-{n}"], [n]
    if country == "fr":
        area, p = rng.choice("123456"), [digits(2) for _ in range(4)]
        return f"+33 {area} {' '.join(p)}", [f"0{area} {' '.join(p)}", f"0{area}.{'.'.join(p)}", f"0{area}{''.join(p)}"], [f"0{area}{''.join(p)}"]
    a, b, c = rng.choice("69") + digits(2), digits(3), digits(3)
    return f"+34 {a} {b} {c}", [f"{a} {b} {c}", f"{a}{b}{c}", f"{a}-{b}-{c}"], [f"{a}{b}{c}"]


def labelled_sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with (start, end, label) of their personal data, full, local and shortened forms alike."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    for _ in range(n):
        text, gold, filler = "", [], rng.choice(FILLER)

        def add(piece: str, label: int = 0) -> None:
            nonlocal text
            text += " " if text else ""
            if label:
                gold.append((len(text), len(text) + len(piece), label))
            text += piece + (rng.choice([".", ","]) if rng.random() < 0.15 and label else "")

        def cue(kind: int) -> None:
            add(rng.choice([c for c, k in CUES.items() if k == kind]) + rng.choice(["", "", ":", "."]))

        user, host = rng.choice(["ann", "joe.b", "info", "maria_k"]) + digits(rng.randint(0, 3)), rng.choice(["mail", "post", "host"]) + digits(rng.randint(0, 1))
        number = digits(15)
        number += next(d for d in "0123456789" if luhn(number + d))
        full, local, short = phone_forms(rng)
        forms = {1: [f"{user}@{host}.example.com"], 2: [".".join(str(rng.randint(0, 255)) for _ in range(4))], 3: [number, "-".join(number[i : i + 4] for i in range(0, 16, 4))]}
        plain = [digits(4), f"{digits(1)}.{digits(1)}", digits(2) + "%", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"19{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", digits(9), "x" + digits(8) + "f", digits(12), digits(7), digits(8), f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/20{digits(2)}", f"{digits(4)}-{digits(2)}", f"{digits(2)} {digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", "@" + rng.choice(filler)]
        kind = rng.choice([0, 0, 1, 2, 3, 4, 4, 4])
        whole = rng.random() < 0.6  # whether the number stands in full
        for part in range(rng.randint(2, 4)):
            for w in rng.choices(filler, k=rng.randint(1, 5)):
                add(w)
            if kind == 4 and part != 1:
                if part == 0 and whole:
                    cue(4) if rng.random() < 0.4 else None
                    add(full, 4)
                elif whole:
                    cue(4) if rng.random() < 0.3 else None
                    add(rng.choice(short + local), 4)
                else:
                    shown = rng.choice(local)
                    if "(" not in shown and "/" not in shown or rng.random() < 0.6:
                        cue(4)
                    add(shown, 4)
            elif kind and part != 1:
                cue(kind) if rng.random() < 0.4 else None
                add(f"{user}@{host}" if kind == 1 and part else rng.choice(forms[kind]), kind)
            else:
                if rng.random() < 0.4:
                    add(rng.choice(COUNTED))
                add(rng.choice(plain))
        yield text, gold


@cache
def fitted(n: int = 1500, seed: int = 11, steps: int = 400) -> SkipChain:
    """Weights by pseudo-likelihood: each token's label given its features and the labels that the graph of inference ties it to."""
    rows, labels = [], []
    for text, gold in labelled_sentences(n, seed):
        places, shown, links = token_graph(text, base_spans(text))
        own = np.array([next((k for a, b, k in gold if a <= begin and end <= b), 0) for begin, end in places], "i8")
        beside, like, based = np.zeros((len(places), len(LABELS))), np.zeros((len(places), len(LABELS))), shown[:, 2:6].any(1)
        for i, j in links:
            beside[i, own[j]] += 1
            beside[j, own[i]] += 1
        for g in shared_keys([keys_of(text[a:b]) for a, b in places]):  # as in marginals: labels of base spans, else what the others agree on
            known = sorted({int(shown[i, 2:6].argmax()) + 1 for i in g if based[i]})
            for i in g:
                if known and not based[i]:
                    like[i, known] += 1
                elif not known:
                    like[i, np.bincount([own[j] for j in g if j != i]).argmax()] += 1
        rows.append(np.concatenate([shown, beside, like], 1))
        labels += own.tolist()
    x, y = np.concatenate(rows), np.eye(len(LABELS))[labels]
    weights, speed = np.zeros((x.shape[1], len(LABELS))), np.zeros((x.shape[1], len(LABELS)))
    for _ in range(steps):
        slope = x.T @ (y - _softmax(x @ weights)) / len(x) - 1e-4 * weights
        speed = 0.9 * speed + slope
        weights += 0.5 * speed
    k = N_FEATURES
    chain, skip = weights[k : k + len(LABELS)], weights[k + len(LABELS) :]
    return SkipChain.of_skip(weights[:k], (chain + chain.T) / 2, (skip + skip.T) / 2)


def token_graph(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """Tokens of a text, their features and chain links of neighbours.

    Tokens don't overlap, so those that a span touches stand side by side; the first span to touch one gives its label.
    """
    places = tokens_of(text)
    starts, ends, label = np.array([a for a, _ in places]), np.array([b for _, b in places]), np.zeros(len(places), "i8")
    if base and places:
        firsts = np.searchsorted(ends, [a for a, _, _ in base], "right").tolist()
        lasts = np.searchsorted(starts, [b for _, _, b in base], "left").tolist()
        for (_, kind, _), i, j in zip(base, firsts, lasts, strict=True):
            touched = label[i:j]
            touched[touched == 0] = kind + 1
    shown = np.array([features(text, a, b, int(k)) for (a, b), k in zip(places, label, strict=True)]).reshape(-1, N_FEATURES)
    links = [(i, i + 1) for i in range(len(places) - 1) if text[places[i][1] : places[i + 1][0]].isspace()]
    return places, shown, links


def field_spans(text: str, base: list[Span], model: SkipChain, sure: float) -> list[Span]:
    """Spans that the field adds: tokens outside base spans whose label is sure; neighbours of one label join."""
    places, shown, links = token_graph(text, base)
    if not places:
        return []
    chances = model.marginals(shown, links, shared_keys([keys_of(text[a:b]) for a, b in places]))
    best = chances[:, 1:].argmax(1) + 1
    starts = np.array([a for a, _, _ in base])
    reach = np.maximum.accumulate([b for _, _, b in base]) if base else np.zeros(0)
    linked, out, last = set(links), [], -1
    for i, (a, b) in enumerate(places):
        k = int(np.searchsorted(starts, b)) if len(starts) else 0  # base spans that start before the token's end
        if chances[i, best[i]] < sure or (k and reach[k - 1] > a):
            continue
        if out and last == i - 1 and (i - 1, i) in linked and out[-1][1] == best[i] - 1:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((a, int(best[i]) - 1, b))
        last = i
    return out


def find(text: str, model: SkipChain, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    return base, sorted(base + field_spans(text, base, model, sure))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, sure: float = 0.9, sentences: int = 1500, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (kind:start:end, in code points) of each row.

    The field labels the tokens of every text, and spreads what it is sure of within a document.
    Null and empty texts have no spans.  Rows that repeat are labelled alike, null ids are kept, an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted(sentences, seed)
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch["text"]:
                base, every = find(t.as_py(), model, sure)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            columns = np.array(counts, "i8").reshape(-1, 4)
            yield pa.record_batch([batch["doc_id"], *(pa.array(columns[:, k].copy()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
