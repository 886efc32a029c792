"""Personal data by fixed patterns and a semi-Markov conditional random field."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_slices, read_documents

#: Kinds that the patterns find, in the order of lists; the field also knows secrets.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Tokens in a span at most, and tokens looked at on each side of one that has a digit, @, + or a word of NAMING.
SPAN, AROUND = 4, 3
#: Training: windows made, passes over them, step, and weight of the Gaussian prior.
WINDOWS, EPOCHS, RATE, PRIOR = 900, 8, 0.3, 1e-3

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: What white space, = and : part; these two end a token.
TOKEN = re.compile(r"[^\x20\x09-\x0D=:]*[=:]+|[^\x20\x09-\x0D=:]+")
#: Words that name secrets. Fixed values.
NAMING = ("token", "key", "secret", "passw", "pwd", "credential", "bearer")
NAMED = re.compile("|".join(NAMING), re.IGNORECASE)
TRIGGER = re.compile("[0-9@+]|" + "|".join(NAMING), re.IGNORECASE)
EDGE = "\"'`.,;:!?<>[]{}|=#*$%&"
OUTSIDE = len(KINDS)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((2 * int(d) - 9) if d > "4" else 2 * int(d) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from each @ to both sides, so that long runs without one cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by kind and start; per kind leftmost and not overlapping, failing matches dropped."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        cards = ((m, "".join(DIGITS.findall(m[0]))) for m in CARD.finditer(text))
        out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def windows_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) around those that TRIGGER marks."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    marked = sorted({j for i, (a, b) in enumerate(tokens) if TRIGGER.search(text, a, b) for j in range(max(0, i - AROUND), min(len(tokens), i + AROUND + 1))})
    runs, last = [], -9
    for j in marked:
        if j != last + 1:
            runs.append([])
        runs[-1].append(tokens[j])
        last = j
    return runs


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in EDGE:
        start += 1
    while start < end and text[end - 1] in EDGE:
        end -= 1
    return start, end


def features(text: str, window: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Of the whole span of tokens i to j (exclusive), and of what stands before it."""
    s = text[slice(*trimmed(text, window[i][0], window[j - 1][1]))]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    given = i > 0 and text[window[i - 1][1] - 1] in "=:"
    before = [k for k in range(max(0, i - 3), i) if text[slice(*window[k])].strip("=:")][-1:]  # the last token that isn't a sign
    named = any(NAMED.search(text, *window[k]) for k in before)
    parts = s.split(".")
    numeric = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    name, _, domain = s.partition("@")
    plain = bool(s) and all(c in "0123456789 -().+" for c in s)
    number = re.sub("[^0-9]", "", s) if 13 <= digits <= 19 and letters == 0 else ""
    one = j - i == 1 and s.isascii() and all(c.isalnum() or c in "-_+/.~" for c in s)
    mixed = sum(a.isupper() != b.isupper() for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha()) > 2
    return np.array([
        1.0, j - i == 1, j - i == 2, j - i == 3, j - i == 4, "@" in s, bool(name) and "." in domain.strip(".") and " " not in s, s.startswith("+"), s.startswith("+") and plain and 9 <= digits <= 15,
        digits == 0, 1 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19, plain, plain and not s.startswith("+") and "." not in s and 13 <= digits <= 19,
        letters == 0, letters > 0 and digits > 0, numeric, numeric and all(len(p) < 4 and int(p) < 256 for p in parts), one and len(s) >= 16 and digits > 2 and letters > 0, one and len(s) >= 24 and digits + mixed > 2,
        given, named, given and named, given and named and one and len(s) >= 8, given and named and one and letters > 0 and digits > 0, one and len(s) < 8, mixed, "(" in s and ")" in s, not s, s.endswith(("=", ":")), plain and s.count(".") > 3, digits == 13 and s.startswith(("978", "979")), bool(number) and luhn(number), bool(number) and not luhn(number),
    ], float)


def candidates(text: str, window: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    n = len(window)
    return {(i, j): features(text, window, i, j) for i in range(n) for j in range(i + 1, min(n, i + SPAN) + 1)}


Weights = tuple[np.ndarray, np.ndarray]  #: of (kind, feature), and of (label, label after it)


def _segment_scores(spans, weights: np.ndarray, n: int) -> np.ndarray:
    """scores[i, j - i - 1, label]; the last label is a token outside of any span, with score 0."""
    scores = np.full((n, SPAN, OUTSIDE + 1), -np.inf)
    if spans:
        at = np.array(list(spans))
        scores[at[:, 0], at[:, 1] - at[:, 0] - 1, :-1] = np.array(list(spans.values())) @ weights.T
    scores[:, 0, -1] = 0.0
    return scores


def _lse(x, axis=0):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top, axis)


def gradient(spans, gold, weights: Weights, n: int) -> Weights:
    """Observed less expected features, of spans and of labels that follow each other, of one window, by the forward and backward sums over its segmentations and labels.

    The label before the first segment counts as outside.
    """
    scores, follow = _segment_scores(spans, weights[0], n), weights[1]
    fore, into, back = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf), np.zeros((n + 1, OUTSIDE + 1))
    fore[0, OUTSIDE] = 0.0
    after = np.full((n, OUTSIDE + 1), -np.inf)  # of all segments that begin there with that label, and what follows them
    for e in range(n + 1):
        if e:
            fore[e] = _lse(np.array([into[e - k] + scores[e - k, k - 1] for k in range(1, min(SPAN, e) + 1)]))
        into[e] = _lse(fore[e][:, None] + follow)
    for b in range(n - 1, -1, -1):
        after[b] = _lse(np.array([scores[b, k - 1] + back[b + k] for k in range(1, min(SPAN, n - b) + 1)]))
        back[b] = _lse(follow + after[b][None, :], 1)
    total = _lse(fore[n])
    out, out_follow = np.zeros_like(weights[0]), np.zeros_like(follow)
    for (i, j), f in spans.items():
        out -= np.exp(into[i] + scores[i, j - i - 1] + back[j] - total)[:-1, None] * f[None, :]
    for i in range(n):
        out_follow -= np.exp(fore[i][:, None] + follow + after[i][None, :] - total)
    last, at = OUTSIDE, 0
    for i, j, kind in [*gold, (n, n, None)]:
        for label in [OUTSIDE] * (i - at) + ([KINDS.index(kind)] if kind else []):
            out_follow[last, label] += 1
            last = label
        if kind:
            out[last] += spans[i, j]
        at = j
    return out, out_follow


def decode(text: str, window: list[tuple[int, int]], weights: Weights) -> list[tuple[str, int, int]]:
    """The best segmentation of a window: spans of at most SPAN tokens with their kinds, chosen together, each label with regard to the one before."""
    n = len(window)
    scores, follow = _segment_scores(candidates(text, window), weights[0], n), weights[1]
    best, how = np.full((n + 1, OUTSIDE + 1), -np.inf), {}
    best[0, OUTSIDE] = 0.0
    into, came = np.zeros((n + 1, OUTSIDE + 1)), np.zeros((n + 1, OUTSIDE + 1), int)
    for e in range(n + 1):
        if e:
            ways = np.array([into[e - k] + scores[e - k, k - 1] for k in range(1, min(SPAN, e) + 1)])
            how[e], best[e] = ways.argmax(0) + 1, ways.max(0)
        step = best[e][:, None] + follow
        into[e], came[e] = step.max(0), step.argmax(0)
    out, e, label = [], n, int(best[n].argmax())
    while e:
        k = int(how[e][label])
        if label < OUTSIDE:
            out.append((KINDS[label], *trimmed(text, window[e - k][0], window[e - 1][1])))
        e, label = e - k, int(came[e - k][label])
    return out[::-1]


def _made_window(r: random.Random) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, str]]]:
    """A made-up window with the tokens and the spans in it, for training."""
    pick = lambda of, n: "".join(r.choice(of) for _ in range(n))
    digits = lambda n: pick("0123456789", n)
    checked = lambda n, good: next(x for x in (f"{d}{k}" for d in [digits(n - 1)] for k in r.sample("0123456789", 10)) if luhn(x) == good)
    parted = lambda x: r.choice([x, x, " ".join(re.findall(".{1,4}", x)), "-".join(re.findall(".{1,4}", x)), ".".join(re.findall(".{1,4}", x)), f"{x[:4]} {x[4:10]} {x[10:]}"])
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick("abcdefghilmnoprstu", r.randint(1, 9)) + r.choice(["", "", "", ",", "."])
    end = r.choice(["", "", ".", ",", "!!", "***", "|"])

    def thing(kind):
        """Texts that stand between spaces, and which part of them is the span."""
        if kind == "email":
            return f"{word().strip('.,')}{r.choice(['', '.', '_'])}{digits(r.randint(0, 2)) or 'a'}@{word().strip('.,')}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'net'])}", None
        if kind == "ip":
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), None
        if kind == "card":
            return parted(checked(r.choice([16, 16, 16, 15, 14]), True)), None
        if kind == "phone":
            return r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(r.randint(5, 7))}", f"+{digits(11)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"]), None
        if kind == "secret":
            of = r.choice(["0123456789abcdef", low + high + "0123456789", low + high + "0123456789-_", low + high, low])
            value = pick(of, r.choice([20, 24, 32, 40, 64]) if of != low else r.randint(12, 24))
            named = r.choice(["", "", "api_", "client-", "my", "X-"]) + r.choice(["token", "key", "secret", "password", "passwd", "pwd", "credential", "Token", "KEY", "Secret"])
            if len(set(of)) > 50 and r.random() < 0.3 and any(c.isdigit() for c in value):
                return f"{r.choice(['', 'bearer ', word() + ' '])}{value}", value
            q = r.choice(['"', "'", "", "", "`"])
            return f"{r.choice(['', '', chr(34)])}{named}{r.choice([' = ', '=', ': ', ':', ' := '])}{q}{value}{q}", value
        if r.random() < 0.05:  # four numbers that are no address
            return ".".join(r.sample([str(r.randint(256, 999)), *(str(r.randint(0, 999)) for _ in range(3))], 4)), ""
        if r.random() < 0.2:  # long numbers that are no cards
            return parted(checked(r.choice([16, 16, 16, 15, 14, 13, 19]), False)), ""
        named = r.choice(["token", "key", "secret", "password", "Token"])
        group = r.choice("- ")
        return r.choice([
            f"{digits(1)}.0.", digits(4), f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}%", f"${digits(3)}", digits(6), "C++", f"v{digits(1)}", f"({digits(4)})", f"{digits(2)}-{digits(2)}-{digits(4)}", "@", "a+b", f"{word()}{digits(1)}", digits(8),
            f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"the {named} of {word()} {word()}", f"{named}: {word()} {word()}", f"{named} {word()}", f"{word()}: {word()}", f"{word()} = {digits(2)}",
            f"https://{word().strip('.,')}.org/{word()}", *(group.join([r.choice(["978", "979"]), digits(1), digits(k), digits(8 - k), digits(1)]) for k in (2, 3, 4)), group.join(["978", digits(1), digits(2), digits(6), digits(1)]), group.join(["979", digits(2), digits(3), digits(4), digits(1)]), f"{named} to {word()}: {pick(low, r.randint(6, 11))}", f"{digits(2)} {digits(2)} {digits(2)}", f"{named} = {digits(1)}", pick(low, r.randint(12, 18)), f"{digits(3)}.{digits(3)}", f"{digits(1)}.{digits(r.randint(8, 17))}", f"{digits(r.randint(9, 11))}", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
        ]), ""

    text, spans = " ".join(word() for _ in range(r.randint(0, AROUND))), []
    for _ in range(r.choice([1, 1, 1, 2])):
        kind = r.choice([*KINDS, None, None])
        made, part = thing(kind)
        at = len(text) + bool(text)
        text = f"{text} {made}" if text else made
        if kind:
            part = made if part is None else part
            begin = at + made.rindex(part)
            spans.append((begin, begin + len(part), kind))
        text += end if r.random() < 0.5 else ""
    text = " ".join([text, *[word() for _ in range(r.randint(0, AROUND))]])
    tokens = [m.span() for m in TOKEN.finditer(text)]
    inside = lambda a, b: [k for k, (x, y) in enumerate(tokens) if x < b and a < y]
    return text, tokens, [(min(t), max(t) + 1, kind) for a, b, kind in spans if (t := inside(a, b)) and len(t) <= SPAN]


@functools.cache
def trained() -> Weights:
    """Weights that maximise the likelihood of WINDOWS made-up windows; the same on every run."""
    r = random.Random(7)
    made = []
    for _ in range(WINDOWS):
        text, window, gold = _made_window(r)
        made.append((candidates(text, window), gold, len(window)))
    weights = (np.zeros((len(KINDS), len(next(iter(made[0][0].values()))))), np.zeros((OUTSIDE + 1, OUTSIDE + 1)))
    squares = tuple(np.full_like(w, 1e-6) for w in weights)
    for _ in range(EPOCHS):
        r.shuffle(made)
        for at in range(0, len(made), 20):
            steps = [gradient(s, gold, weights, n) for s, gold, n in made[at : at + 20]]
            for w, q, *g in zip(weights, squares, *steps):
                g = sum(g) / 20 - PRIOR * w
                q += g * g
                w += RATE * g / np.sqrt(q)
    return weights


def all_spans(text: str, weights: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """What the patterns find, and that with the field's spans that touch none of it; both by kind and start."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    added = [x for window in windows_of(text) for x in decode(text, window, weights) if x[1] < x[2]]
    taken = sorted((a, b) for _, a, b in base)
    free = [x for x in added if not any(a < x[2] and x[1] < b for a, b in taken)] if len(taken) < 50 else _apart(added, taken)
    return base, sorted(base + free, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _apart(spans, taken):
    starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
    keep = []
    for x in spans:
        k = int(np.searchsorted(starts, x[2]))
        if k == 0 or reach[k - 1] <= x[1]:
            keep.append(x)
    return keep


SPANS = "array<struct<kind:string,start:long,stop:long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans, both arrays of (kind, start, stop) in code points, stop exclusive.

    base has what the fixed patterns find. spans adds what the field finds around tokens with a
    digit, @, + or a word that names secrets: every run of up to SPAN tokens is a candidate with
    features of the whole run, and dynamic programming chooses boundaries and kinds of a window
    together, with weights for kinds that follow each other. A span of the field that touches one of
    the patterns' gives way. Tokens farther than AROUND from any such token are never candidates. The
    field is trained on made-up windows, so it doesn't depend on the corpus, and every row is scored
    by itself in one pass.

    Defined cases: null and empty texts have no spans; very long texts are read whole, in windows;
    repeated rows get equal results, and rows without doc_id are scored like others; an empty table
    gives no rows; further columns are ignored, whatever their names.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    @in_slices
    def find(batches):
        for batch in batches:
            both = [all_spans(t, weights.value) for t in batch.column("text").to_pylist()]
            rows = lambda k: pa.array([[{"kind": x[0], "start": x[1], "stop": x[2]} for x in b[k]] for b in both], SPANS_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows(0), rows(1)], names=["doc_id", "base", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(find, f"doc_id long, base {SPANS}, spans {SPANS}")


def query(spark, sf_dir: str) -> DataFrame:
    found = personal_data(read_documents(spark, sf_dir))
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("found"))


SQL = None
