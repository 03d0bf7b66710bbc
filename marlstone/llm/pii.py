"""Personal data: base patterns, and candidate spans judged by gradient-boosted trees."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The trees are fitted on planted spans: PLANTS texts made from snippets of SNIPPET characters at most,
#: one of each of SNIPPETS documents at most, those of the smallest hashes.
SNIPPETS, SNIPPET, PLANTS = 4000, 240, 16_000
TREES, DEPTH, RATE, BINS, SMOOTH = 30, 3, 0.3, 16, 1.0
#: Precision asked for on held-out spans, and the least calibrated probability.
PRECISION, LEAST = 0.99, 0.9

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL = frozenset(_ALNUM + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().\-/]{1,2}")
_NOT_BEFORE, _NOT_AFTER = frozenset(_ALNUM + "+"), frozenset(_ALNUM + "@")
_DOT = r"(?:\.| \. | ?(?:\[(?:dot|\.)\]|\((?:dot|\.)\)) ?)"
_MASKED = re.compile(rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++")
_SPOKEN = re.compile(r"(?i)(?<![a-z0-9._%+-])(?<! dot )[a-z0-9._%+-]++(?: dot [a-z0-9._%+-]++)*+ at [a-z0-9-]++(?: dot [a-z0-9-]++)++")
_MASKED_IP = re.compile(rf"(?i)(?<![0-9])[0-9]++(?:{_DOT}[0-9]++)++")


_MAY_MASK = re.compile(r"(?i)@|[\[(]at[\])]| at [a-z0-9-]+ dot ")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that the work stays linear."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base patterns, leftmost and non-overlapping within each kind."""
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15],
    }


FEATURES = ("length", "digits", "digit_runs", "run_1", "run_2", "run_3", "run_4", "last_run", "longest_run", "first_number", "largest_number", "separators", "kinds_of_separator", "first_separator", "plus", "brackets", "dots", "slashes", "luhn", "issuer", "first_digit", "zeros", "at_sign", "masked", "letter_share", "letters_after_at", "last_label", "spaces", "after_space", "before_space", "left_colon", "left_letter", "cue", "line_start", "digits_near", "spoken", "known_top", "leading_zero", "larger_parts")
_CUE = re.compile(r"(?i)\b(tel|phone|telefon|call|fax|mobile?|cell|card|visa|pay|mail|e-mail|contact|write|reach)\b")
# Common top-level labels.
_TOPS = frozenset("com org net edu gov int info biz io de fr uk es it nl pl ru ch at be se no dk fi pt ie eu us ca au jp cn in br example".split())
_AT = re.compile(r"(?i) ?(?:@|\[at\]|\(at\)) ?| at ")


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span and its context, as numbers in the order of FEATURES."""
    s = text[start:end]
    d = _digits(s)
    runs = _GROUP.findall(s)
    sizes = [len(r) for r in runs]
    seps = re.findall("[^A-Za-z0-9]", s)
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    host = _AT.split(s, maxsplit=1)[-1]
    last = re.split(r"[.\]) ]", s)[-1]
    return [len(s), len(d), len(runs), *(sizes + [0] * 4)[:4], sizes[-1] if sizes else 0, max(sizes, default=0), min(9999, int(runs[0][:5])) if runs else -1, max((min(9999, int(r[:5])) for r in runs), default=0), len(seps), len(set(seps)), " -./()[@".find(seps[0]) if seps else -2, "+" in s, s.count("("), s.count("."), s.count("/"), 13 <= len(d) <= 19 and luhn(d), d[:1] in "3456" and d != "", int(d[0]) if d else -1, d.startswith("00"), "@" in s, "[" in s or "(at)" in s.lower(), sum(c.isalpha() for c in s) / len(s), sum(c.isalpha() for c in host), len(last), s.count(" "), right[:1].isspace() or not right, left[-1:].isspace() or not left, left.rstrip().endswith((":", "=")), left[-1:].isalpha(), bool(_CUE.search(left)), not left or left.endswith("\n"), len(_digits(left + right)), " dot " in s.lower(), last.lower() in _TOPS, d.startswith("0") and d[1:2] != "0", sum(len(r.lstrip("0")) > 3 or int(r[-3:]) > 255 for r in runs)]


def number_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of each span of whole digit groups, one or two separators apart, of 4 to
    19 digits: all starts and ends at group boundaries, so that numbers side by side are told apart."""
    groups = []
    for m in _GROUP.finditer(text):
        s = m.start()
        first = -1
        for a in (s - 2, s - 1, s):
            # an opening bracket, a plus or both belong to the number
            if a >= 0 and text[a:s] in ("+(", "+", "(", "") and not (a and text[a - 1] in _NOT_BEFORE):
                first = a
                break
        linked = bool(groups) and _BETWEEN.fullmatch(text, groups[-1][1], s) is not None
        groups.append((first, m.end(), m.end() - s, linked, m.end() == len(text) or text[m.end()] not in _NOT_AFTER))
    out = []
    for i, (start, *_) in enumerate(groups):
        n, j = 0, i
        while start >= 0 and j < len(groups) and (j == i or groups[j][3]) and (n := n + groups[j][2]) <= 19:
            if n >= 4 and groups[j][4]:
                out.append((start, groups[j][1], n))
            j += 1
    return out


def masked_spans(text: str) -> list[tuple[int, int]]:
    """Masked and spoken addresses of any length, with the whole host. A plain dot joins labels only with
    no space beside it or one on both sides, as a sentence may go on after the address ("jo [at] uni.net. Then")."""
    return [m.span() for p in (_MASKED, _SPOKEN) for m in p.finditer(text)]


def masked_numbers(text: str) -> list[tuple[int, int]]:
    """Numbers of four parts joined by dots, some of them masked or spaced ("10[.]0[.]0[.]1")."""
    return [m.span() for m in _MASKED_IP.finditer(text) if len(_GROUP.findall(m[0])) == 4 and not _IP.fullmatch(m[0])]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of high recall: (kind, start, end)."""
    out = [("email", *s) for s in masked_spans(text)] if _MAY_MASK.search(text) else []
    out += [("ip", *s) for s in masked_numbers(text)]
    for start, end, n in number_spans(text):
        s = text[start:end]
        if n <= 12 and s.count(".") == 3 and not re.search("[^0-9.]", s):
            out.append(("ip", start, end))
        if n >= 12:
            out.append(("card", start, end))
        if 7 <= n <= 15:
            out.append(("phone", start, end))
    return out


@dataclass
class Trees:
    """Gradient-boosted regression trees on the logistic loss, with Platt scaling and a threshold."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for nodes in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f, cut, low = nodes[0][at], nodes[1][at], nodes[2][at]
                at = np.where(f < 0, at, low + (x[np.arange(len(x)), np.maximum(f, 0)] > cut))
            out += nodes[3][at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray):
    """One tree by best gain, level by level: arrays of feature (-1: leaf), cut, first child, value."""
    feature, cut, child, value = [-1], [0.0], [0], [0.0]
    open_ = [(0, np.arange(len(x)), 0)]
    while open_:
        node, rows, depth = open_.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = RATE * g / (h + SMOOTH)
        if depth == DEPTH or len(rows) < 8:
            continue
        best = (1e-6, -1, 0.0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            slot = np.searchsorted(edges, x[rows, f], side="left")
            gl = np.cumsum(np.bincount(slot, grad[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hess[rows], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, edges[k])
        if best[1] < 0:
            continue
        feature[node], cut[node], child[node] = best[1], best[2], len(feature)
        right = x[rows, best[1]] > best[2]
        for k, part in enumerate((rows[~right], rows[right])):
            open_.append((len(feature), part, depth + 1))
            feature.append(-1), cut.append(0.0), child.append(0), value.append(0.0)
    return tuple(np.array(v) for v in (feature, cut, child, value))


def fit_trees(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Fit on rows not held, calibrate on the held ones: Platt scaling, then the smallest threshold
    whose precision on them is PRECISION at least. Without both classes in both parts nothing is found."""
    model = Trees()
    a, b = ~held, held
    if min(y[a].sum(), (1 - y[a]).sum(), y[b].sum(), (1 - y[b]).sum()) < 5:
        return model
    cuts = [np.unique(np.quantile(x[a, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate((c, (np.unique(x[a, f])[:-1] if len(np.unique(x[a, f])) <= BINS else [])))) for f, c in enumerate(cuts)]
    p0 = y[a].mean()
    model.prior = math.log(p0 / (1 - p0))
    score = np.full(a.sum(), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        model.trees.append(_grow(x[a], cuts, y[a] - p, p * (1 - p)))
        score = Trees(model.prior, model.trees).raw(x[a])
    raw, t = model.raw(x[b]), (y[b] * (y[b].sum() + 1) + (1 - y[b])) / (np.where(y[b] > 0, y[b].sum(), (1 - y[b]).sum()) + 2)
    w = np.array([1.0, 0.0])
    design = np.column_stack((raw, np.ones(len(raw))))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2)
        step = np.linalg.solve(curve, design.T @ (t - p) - (w - [1.0, 0.0]))
        w = w + step / max(1.0, float(np.abs(step).max()))
    model.scale = (float(w[0]), float(w[1]))
    p = model.probability(x[b])
    order = np.argsort(-p, kind="stable")
    good = np.flatnonzero(np.cumsum(y[b][order]) >= PRECISION * np.arange(1, len(order) + 1))
    if len(good):
        # halfway to the first held span that is left out
        last, after = float(p[order[good[-1]]]), order[good[-1] + 1 :]
        model.threshold = max(LEAST, (last + float(p[after[0]])) / 2 if len(after) else LEAST)
    return model


def _card(rnd: random.Random) -> str:
    head = rnd.choice(["4", "51", "53", "55", "37", "6011", *"123456789"])
    n = 15 if head == "37" else 16
    d = head + "".join(rnd.choice("0123456789") for _ in range(n - len(head) - 1))
    return d + next(c for c in "0123456789" if luhn(d + c))


def _groups(d: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(d[at : at + n])
        at += n
    return sep.join(out)


def planted_span(rnd: random.Random) -> tuple[str, str, bool | None]:
    """(kind, text, whether it is personal data of that kind), made by rules that know the truth and
    ask no pattern: forms people write, among them those the base patterns miss, and look-alikes. None
    stands for a short number, which is a phone's only where the words before it say so."""
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = rnd.choice(["jo", "anna.k", "m_lee", "info", "r.diaz", "user"]) + rnd.choice(["", num(2)])
    host, top = rnd.choice(["mail", "post", "example", "corp-net", "uni"]) + rnd.choice(["", num(1)]), rnd.choice(["com", "org", "net", "de", "fr", "example"])
    area, rest, line = f"{rnd.randint(201, 989)}", f"{rnd.randint(200, 999)}", num(4)
    card = _card(rnd)
    by_four = [4] * (len(card) // 4) + [len(card) % 4] * (len(card) % 4 > 0)
    bad = card[:-1] + str((int(card[-1]) + rnd.randint(1, 9)) % 10)
    day, month, year = f"{rnd.randint(1, 28):02d}", f"{rnd.randint(1, 12):02d}", str(rnd.randint(1900, 2035))
    octets = [str(rnd.randint(0, 255)) for _ in range(4)]
    ip, masks = ".".join(octets), ["[.]", "(.)", "[dot]", " [dot] ", " . "]
    mask, word = rnd.choice(masks), lambda: rnd.choice(["red", "polka", "home", "the", "every", "tie", "noon", "first", "shop", "small"])
    sub = rnd.choice(["mail", "cs", "dept"])
    return rnd.choice([
        ("email", f"{name} [at] {host} [dot] {top}", True), ("email", f"{name}(at){host}.{top}", True), ("email", f"{name} @ {host}.{top}", True), ("email", f"{name}[at]{host}.{top}", True), ("email", f"{name} (at) {host} (dot) {top}", True), ("email", f"{name} [at] {host}.example [dot] {top}", True), ("email", f"{name.split('.')[0]} [at] {host}.{top}", True),
        ("email", f"{rnd.randint(2, 90)} @ {rnd.randint(1, 9)}.{num(2)}", False), ("email", f"{rnd.choice(['met', 'look', 'sold'])} @ {num(2)}.{num(1)}", False), ("email", f"{name}(at){num(1)}.{num(2)}", False),
        ("email", f"{name.replace('.', ' dot ')} at {host} dot {top}", True), ("email", f"{name} at {sub} dot {host} dot {top}", True), ("email", f"{name} @ {sub}.{host}.{top}", True), ("email", f"{name} [AT] {host} [DOT] {top}", True), ("email", f"{name} @ {host} . {top}", True), ("email", f"{name} [at] {host}.co.uk", True),
        ("email", f"{word()} at {word()} dot {word()}", False), ("email", f"{word()} at {word()} dot {word()}", False), ("email", f"{word()} @ {word()} . {word()}", False),
        ("ip", mask.join(octets), True), ("ip", ".".join(octets[:3]) + mask + octets[3], True), ("ip", octets[0] + mask + ".".join(octets[1:]), True), ("ip", mask.join([*octets[:3], str(rnd.randint(256, 999))]), False), ("ip", mask.join([num(4), *octets[1:]]), False), ("ip", ".".join([*octets[:3], str(rnd.randint(256, 999))]), False), ("ip", ".".join([str(rnd.randint(256, 999)), *octets[1:]]), False),
        ("ip", f"{rnd.randint(256, 999)}.{ip}", False), ("ip", ip, True), ("ip", f"{rnd.randint(256, 999)}.{num(1)}.{rnd.randint(256, 999)}.{num(2)}", False),
        ("card", card, True), ("card", _groups(card, by_four, "."), True), ("card", _groups(card, by_four, "/"), True), ("card", _groups(card, by_four, "  "), True), ("card", _groups(card, by_four, " "), True),
        ("card", bad, False), ("card", _groups(bad, by_four, "."), False), ("card", _groups(bad, by_four, " "), False), ("card", f"17{num(11)}", False), ("card", f"{year}{month}{day}{num(6)}", False),
        ("phone", f"({area}) {rest}-{line}", True), ("phone", f"{area}-{rest}-{line}", True), ("phone", f"{area}.{rest}.{line}", True), ("phone", f"{area} {rest} {line}", True), ("phone", f"00{rnd.randint(30, 49)} {area} {num(7)}", True), ("phone", f"1-{area}-{rest}-{line}", True), ("phone", f"+1 ({area}) {rest}-{line}", True),
        ("phone", f"0{num(2)} {num(4)} {num(4)}", True), ("phone", f"0{rnd.randint(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}", True), ("phone", f"0{rnd.randint(10, 9999)}{rnd.choice(' -/')}{num(rnd.randint(6, 8))}", True), ("phone", f"0{rnd.randint(1000, 9999)} {num(3)} {num(3)}", True), ("phone", f"00{rnd.randint(30, 49)} {num(3)} {num(6)}", True), ("phone", f"{rest}-{line}", None), ("phone", f"{rest}-{line}", None), ("phone", f"{rest} {line}", None),
        ("phone", " ".join(f"{rnd.randint(1, 49)}" for _ in range(rnd.randint(4, 6))), False), ("phone", " ".join([str(rnd.randint(10, 99)), *(num(2) for _ in range(4))]), False), ("phone", f"{num(2)}.{line} {num(2)}.{num(4)}", False),
        ("phone", f"{year}-{month}-{day}", False), ("phone", f"{day}.{month}.{year}", False), ("phone", f"{day}/{month}/{year}", False), ("phone", f"{year}-{int(year) + rnd.randint(1, 9)}", False), ("phone", f"978-3-{num(2)}-{num(6)}-{num(1)}", False), ("phone", f"{num(1)}.{num(8)}", False), ("phone", f"{rnd.randint(1, 999)} {num(3)} {num(3)}", False), ("phone", num(rnd.randint(7, 12)), False), ("phone", f"{num(2)}-{num(2)}-{num(2)}-{num(2)}", False), ("phone", f"{num(5)}-{num(4)}", False), ("phone", f"{year} {num(4)}", False),
    ])


def planted_text(snippet: str, rnd: random.Random) -> tuple[str, list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(text, true spans, all planted places): a snippet with one or two spans between its words; half of
    pairs stand side by side, half of those of forms that the base finds alone but may lose as neighbours."""
    words = snippet.split(" ")
    cuts = sorted(rnd.randrange(len(words) + 1) for _ in range(rnd.choice((1, 1, 2))))
    known = False
    if len(cuts) == 2 and rnd.random() < 0.5:
        cuts[1] = cuts[0]
        known = rnd.random() < 0.5
    out, truth, places, at = "", [], [], 0
    for cut in cuts:
        before = " ".join(words[at:cut])
        out += (" " if out and before else "") + before
        kind, span, good = planted_span(rnd)
        while known and not base_spans(span)[kind]:
            kind, span, good = planted_span(rnd)
        cue = rnd.choice(["", "", "", "", "", "call ", "tel: ", "card ", "write "])
        if good is None:
            cue = rnd.choice(["", "", "call ", "tel: ", "tel ", "phone "])
            good = cue != ""
        out += (" " if out else "") + cue
        places.append((len(out), len(out) + len(span)))
        if good:
            truth.append((kind, *places[-1]))
        out += span
        at = cut
    tail = " ".join(words[at:])
    return out + rnd.choice(["", "", ",", "."]) + (" " if tail else "") + tail, truth, places


def training_rows(snippets: list[str], plants: int = PLANTS, seed: int = 11) -> list[tuple[str, int, bool, list[float]]]:
    """(kind, label, held, features) of the candidates that touch planted spans and no base span. A
    candidate is true if it is a planted true span of its kind, end for end. What stands in the
    snippet itself is left out, as the truth about it is not known."""
    out = []
    for i in range(plants if snippets else 0):
        rnd = random.Random(f"{seed}:{i}")
        text, truth, places = planted_text(snippets[i % len(snippets)], rnd)
        taken = [s for spans in base_spans(text).values() for s in spans]
        for kind, a, b in candidates(text):
            if any(a < e and b > s for s, e in places) and not any(a < e and b > s for s, e in taken):
                out.append((kind, int((kind, a, b) in truth), i % 2 == 1, [float(f) for f in features(text, a, b)]))
    return out


def fit_models(snippets: list[str], plants: int = PLANTS) -> dict[str, Trees]:
    """Trees for each kind, fitted on planted spans in half of the texts, calibrated on the other half."""
    rows, out = training_rows(snippets, plants), {}
    for kind in KINDS:
        part = [r for r in rows if r[0] == kind]
        x = np.array([r[3] for r in part]) if part else np.zeros((0, len(FEATURES)))
        out[kind] = fit_trees(x, np.array([r[1] for r in part], dtype=float), np.array([r[2] for r in part], dtype=bool))
    return out


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> dict[str, Trees]:
    """Trees fitted on spans planted in a bounded sample of the documents' own words (SNIPPETS, SNIPPET,
    PLANTS). The sample is chosen by a hash, so it does not depend on files or partitions."""
    t = F.col(text)
    spread = F.xxhash64(F.col(doc_id), t)
    some = docs.where(F.length(t) > 0).select(spread.alias("h"), F.substr(t, (F.pmod(spread, F.greatest(F.lit(1), F.length(t) - SNIPPET)) + 1).cast("int"), F.lit(SNIPPET)).alias("s"))
    return fit_models([r["s"] for r in some.orderBy("h", "s").limit(SNIPPETS).collect()])


def find_spans(texts: list[str | None], models: dict[str, Trees]) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """(base spans by kind, all spans by kind and start) of each text; added ones overlap no other span.

    The candidates of all texts are judged together, in blocks; each tree runs once for a block."""
    base = [base_spans(t) if t else {k: [] for k in KINDS} for t in texts]
    new: list[list] = [[] for _ in texts]
    held: dict[str, list] = {k: [] for k in KINDS}

    def judge(kind: str) -> None:
        rows = held[kind]
        if rows:
            p = models[kind].probability(np.array([r[3] for r in rows], dtype=float))
            for x, (i, a, b, _) in zip(p.tolist(), rows, strict=True):
                if x >= models[kind].threshold:
                    new[i].append((x, kind, a, b))
            rows.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        taken = sorted(s for spans in base[i].values() for s in spans)
        starts = [a for a, _ in taken]
        upto = list(accumulate((b for _, b in taken), max))
        for kind, a, b in candidates(t):
            k = bisect_left(starts, b) - 1  # the last base span that starts before the candidate ends
            if models[kind].trees and (k < 0 or upto[k] <= a):
                held[kind].append((i, a, b, features(t, a, b)))
                if len(held[kind]) >= 8192:
                    judge(kind)
    for kind in KINDS:
        judge(kind)
    out = []
    for i in range(len(texts)):
        spans = [(kind, a, b) for kind in KINDS for a, b in base[i][kind]]
        # of spans of equal probability the longer one, so that no part of a number is left
        picked: list[tuple[int, int]] = []
        for _, kind, a, b in sorted(new[i], key=lambda s: (-s[0], s[2] - s[3], s[2], s[1])):
            k = bisect_left(picked, (a, b))
            if (k == 0 or picked[k - 1][1] <= a) and (k == len(picked) or picked[k][0] >= b):
                picked.insert(k, (a, b))
                spans.append((kind, a, b))
        out.append((base[i], sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of spans becomes the mark of its first kind; overlapping spans are one run."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", models: dict[str, Trees] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and
    spans (base and added, "kind:start:end" by kind then start, comma-joined, in code points).

    Generators propose overlapping spans of high recall, among them every part of a run of numbers at
    group boundaries whose digits fit a kind; boosted trees on format and context features judge
    those that overlap no base span, and calibrated thresholds choose. The trees learn from spans
    planted in snippets of the documents, whose truth is known from their making (train).

    A null or empty text has no spans; a null doc_id stays null; texts of any length are read whole;
    equal rows are judged alike; ties of probability go to the longer, then the earlier span; an
    empty table gives no rows. Other columns are ignored, whatever their names."""
    models = train(docs, text, doc_id) if models is None else models

    def find(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, spans in find_spans(batch.column("text").to_pylist(), models):
                line = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)]
                for to, v in zip(out, row, strict=True):
                    to.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    t = F.col(text)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(_may_hold(t), t).alias("text"))
    return src.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _may_hold(text: Column) -> Column:
    """No pattern and no generator finds anything in other texts."""
    return text.rlike("[0-9@]") | text.rlike(r"(?i)[\[(]at[\])]| at [a-z0-9-]+ dot ")


def redact_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", models: dict[str, Trees] | None = None) -> DataFrame:
    """docs with each span that find_private finds replaced by its kind in brackets, all else as it was.

    Nulls, empty and long texts, equal rows and empty tables are as in find_private; other columns
    go through as they are."""
    models = train(docs, text, doc_id) if models is None else models
    at = docs.columns.index(text)

    def change(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redact(t, spans) if t else t for t, (_, spans) in zip(texts, find_spans(texts, models), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    hit = docs.where(_may_hold(F.col(text))).mapInArrow(change, docs.schema)
    return docs.where(~F.coalesce(_may_hold(F.col(text)), F.lit(False))).unionByName(hit)
