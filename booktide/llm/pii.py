"""Personal data: fixed patterns, and a semi-Markov conditional random field (Sarawagi and Cohen 2004) that adds spans they miss."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a span at most, sentences to learn from, passes over them, step and L2 strength.
MOST_TOKENS, SENTENCES, EPOCHS, STEP, DECAY = 5, 500, 4, 0.3, 1e-3
#: An added span needs this margin in score over reading its tokens as plain ones.
MARGIN = 2.0

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that hold; by kind, then place. One pass over the text for each kind."""
    out: list[Span] = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LETTERS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at += 1
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Fixed word list: what often stands before a kind.
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "pan"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"},
}
#: Stretches worth a look: tokens with a digit or @, and mail addresses spelled with (at) and (dot).
_SPACE = re.compile(r"\s")
_AT = re.compile(r"[(\[]at[)\]]")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
_TRIM_LEFT, _TRIM_RIGHT = "\"'<{[,;:", "\"'>}],;:.!?"


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM_LEFT:
        start += 1
    opened = text.find("(", start, end) >= 0
    while end > start and (text[end - 1] in _TRIM_RIGHT or text[end - 1] == ")" and not opened):
        end -= 1
    return start, end


def seeds(text: str) -> list[tuple[int, int]]:
    """The stretches worth a look, by place and without overlaps, in time linear in the text: (start, end) of each."""
    spelled, last = [], 0
    for m in _AT.finditer(text):
        name = m.start() - (m.start() > last and text[m.start() - 1] == " ")
        start = name
        while start > last and text[start - 1] in _NAME:
            start -= 1
        after = _AFTER_AT.match(text, m.end()) if start < name else None
        if after:
            last = after.end()
            spelled.append((start, last))
    out, at, k = [], 0, 0
    while True:
        m = _ANY.search(text, at)
        if k < len(spelled) and (m is None or spelled[k][0] <= m.start()):
            start, end = spelled[k]
            k += 1
        elif m is None:
            return out
        else:
            start = m.start()
            while start > at and not text[start - 1].isspace():
                start -= 1
            stop = _SPACE.search(text, m.end())
            end = min(stop.start() if stop else len(text), spelled[k][0] if k < len(spelled) else len(text))
        out.append((start, end))
        at = end


def clusters(text: str, taken: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring seed tokens that no base span touches, as (start, end) of each token."""
    run: list[tuple[int, int]] = []
    blocked = sorted((s, e) for _, s, e in taken)
    k = 0
    for start, end in seeds(text):
        while k < len(blocked) and blocked[k][1] <= start:
            k += 1
        hit = k < len(blocked) and blocked[k][0] < end
        if run and (hit or start - run[-1][1] > 1 or text[run[-1][1] : start] not in (" ", "")):
            yield run
            run = []
        if not hit:
            run.append((start, end))
    if run:
        yield run


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Features of the whole span of tokens i to j, and of the word before it (of its last 24 characters). Shapes of over 24 characters are one, and groups count up to the sixth."""
    start, end = _trimmed(text, tokens[i][0], tokens[j][1])
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span))
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), span))
    if len(shape) > 24:
        shape = "long"
    before = text[max(0, tokens[i][0] - 24) : tokens[i][0]].rsplit(None, 1)
    cue = before[-1].strip(".,:;()").lower() if before else ""
    dotted = span.split(".")
    out = [
        f"n{len(digits)}" if len(digits) < 20 else "n20", f"shape {shape}", f"tokens {j - i + 1}",
        "luhn" if 13 <= len(digits) <= 19 and luhn(digits) else "no luhn",
        f"@{min(span.count('@'), 2)}" + (" dot" if "." in span[span.find("@") :] else ""),
        "letters" if any(c.isalpha() for c in span) else "no letters",
        "plus" if span.startswith("+") else "bracket" if span.startswith("(") else "bare",
        "spelled" if re.search(r"[(\[]at[)\]].*[(\[]dot[)\]]", span) else "plain",
        "quad" if len(dotted) == 4 and all(x.isdigit() and len(x) < 4 and int(x) < 256 for x in dotted) else "no quad",
        "groups " + "-".join(str(len(g)) for g in re.findall(r"[0-9]+", span)[:6]),
    ]
    out += [f"cue {k}" for k, words in CUES.items() if cue in words] or ["no cue"]
    return tuple(out)


class Model:
    """Weights of (kind, feature); a token outside spans scores 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = defaultdict(float, weights or {})

    def scores(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[str, float, tuple[str, ...]]]]:
        out = {}
        for i in range(len(tokens)):
            for j in range(i, min(i + MOST_TOKENS, len(tokens))):
                own = features(text, tokens, i, j)
                out[i, j] = [(k, sum(self.weights.get((k, f), 0.0) for f in own), own) for k in KINDS]
        return out

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The spans of the best segmentation: best[j] is the best score of the first j tokens."""
        n = len(tokens)
        score = self.scores(text, tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(n):
            best[j + 1], back[j + 1] = best[j], None
            for i in range(max(0, j - MOST_TOKENS + 1), j + 1):
                for kind, s, _ in score[i, j]:
                    if best[i] + s - MARGIN > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + s - MARGIN, (i, kind)
        spans, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                spans.append((kind, *_trimmed(text, tokens[i][0], tokens[j - 1][1])))
                j = i
        return spans[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, str]]) -> None:
        """One step along the gradient of the log-likelihood, by the forward and backward sums over all segmentations."""
        n = len(tokens)
        score = self.scores(text, tokens)
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        for j in range(n):
            ahead[j + 1] = ahead[j]
            for i in range(max(0, j - MOST_TOKENS + 1), j + 1):
                for _, s, _ in score[i, j]:
                    ahead[j + 1] = add(ahead[j + 1], ahead[i] + s)
        for i in reversed(range(n)):
            behind[i] = behind[i + 1]
            for j in range(i, min(i + MOST_TOKENS, n)):
                for _, s, _ in score[i, j]:
                    behind[i] = add(behind[i], s + behind[j + 1])
        for (i, j), kinds in score.items():
            for kind, s, own in kinds:
                gap = ((i, j, kind) in gold) - math.exp(ahead[i] + s + behind[j + 1] - ahead[n])
                if abs(gap) > 1e-4:
                    for f in own:
                        self.weights[kind, f] += STEP * (gap - DECAY * self.weights[kind, f])


def _sentence(draw: random.Random) -> tuple[str, list[Span]]:
    """A made-up stretch of tokens with its spans: personal data in many spellings, and numbers that are none."""
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(draw.randint(3, 8)))
    text, spans = "", []

    def card() -> str:
        body = draw.choice("3456") + d(14)
        full = next(body + x for x in "0123456789" if luhn(body + x))
        sep = draw.choice(["", " ", "-", ".", "/"])
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        area, first, last = d(3), d(3), d(4)
        return draw.choice([f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"+1 ({area}) {first}-{last}", f"{area}.{first}.{last}", f"1-{area}-{first}-{last}", f"+{d(2)} {d(3)} {d(6)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}"])

    def email() -> str:
        host, name = f"{word()}{draw.choice(['', '1', '-2'])}", draw.choice([word(), f"{word()}.{d(2)}", f"{word()}_{word()}"])
        return draw.choice([f"{name}@{host}.com", f"{name}@{host}.example.org", f"{name} (at) {host} (dot) com", f"{name}[at]{host}[dot]net", f"{name} [at] {host} [dot] org"])

    made = {"email": email, "card": card, "phone": phone, "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))}
    other = [
        lambda: d(draw.randint(1, 4)), lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{draw.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}:{d(2)}",
        lambda: f"{word()}{d(2)}", lambda: d(draw.randint(5, 12)), lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(3)}-{d(4)}", lambda: f"{d(16)}", lambda: f"@{word()}", lambda: "".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(20)), lambda: f"{word()}={draw.getrandbits(72):018x}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}",
    ]
    for _ in range(draw.randint(1, 4)):
        if draw.random() < 0.5:
            kind = draw.choice(KINDS)
            text += draw.choice([word(), draw.choice(sorted(CUES[kind]))]) + draw.choice([" ", ": "])
            own = made[kind]()
            spans.append((kind, len(text), len(text) + len(own)))
            text += own
        else:
            own = draw.choice(other)()
            if own.isdigit() and 13 <= len(own) <= 19 and luhn(own):
                own = own[:-1] + str((int(own[-1]) + 1) % 10)
            text += f"{word()} {own}"
        text += draw.choice([" ", ". ", f" {word()} "])
    return text, spans


@functools.cache
def trained(seed: int = 8) -> Model:
    """The model, learnt from SENTENCES made-up sentences; the same on each run."""
    draw, model = random.Random(seed), Model()
    data = [_sentence(draw) for _ in range(SENTENCES)]
    for _ in range(EPOCHS):
        for text, spans in data:
            for tokens in clusters(text, []):
                inside = [(k, [t for t in range(len(tokens)) if tokens[t][0] < e and tokens[t][1] > s]) for k, s, e in spans]
                gold = {(t[0], t[-1], k) for k, t in inside if t}
                model.learn(text, tokens, gold)
    return model


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and place: the base ones and what the model adds beside them."""
    if not _ANY.search(text) and "at)" not in text and "at]" not in text:
        return [], []
    base = base_spans(text)
    added = [s for tokens in clusters(text, base) for s in model.best(text, tokens)]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs (doc_id, text).

    Counts and hash are of the base spans; spans has the model's too, as kind:start:end in code points, joined by commas. A null or empty
    text has none. Texts are read whole: each pattern in one pass, the model where tokens hold digits, an @ or a spelled (at). Its
    segmentation is linear in their number, for a span has MOST_TOKENS tokens at most. Repeated rows each get a row, an empty table none;
    a null id is carried along. Other columns of docs play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(trained().weights))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kinds = Model(shared.value), (*[pa.int64()] * 5, pa.string(), pa.string())
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        told = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, every = all_spans(text or "", model)
                rows.append((doc, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return mapped(docs.select("doc_id", "text"), find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
