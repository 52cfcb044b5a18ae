"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds secrets and identity numbers.

Base spans (email, ip, card, phone) follow their patterns, leftmost and non-overlapping per kind; a match that fails its check is dropped.
They are found by scans that stay linear on runs of any length, and they always stay.

The field labels whole segments as secret, id, one of the base kinds, or other: span features (length, mix of characters, prefix, word
before, sign before) and a transition score one segment; bounded-entity dynamic programming picks boundaries and types together. A token is words joined
by signs without a blank (`550e8400-e29b`, `a.b_c/d`), of any length, cut only where a base span begins or ends; so a secret, however many words its signs join, is one token, and
a segment is of up to MAX_TOKENS tokens: more than the nine groups of the longest account number that is written with blanks. Secrets and
ids are segments that hold a token of MIN_CHARS characters with a digit or mixed case, or MIN_CHARS digits, or that stand after a
keyword (password, token, ssn, ...) and hold a token of MIN_CHARS characters or one joined by other signs than in words; base kinds compete for the tokens of the base spans. All other segments are of label other, score 0. So only
MARGIN tokens around digits, mixed case, keywords and base spans are decoded: no other token can be part of an entity, and the result is that of decoding the whole text. The field is
trained by maximum likelihood (forward-backward gradients) on sentences made from a fixed seed. Added spans never overlap base spans.

Defined cases: null text is empty and has no spans; repeated rows are each returned; an empty table gives no rows; very
long texts are scanned whole; positions are code points, ends exclusive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "id")
MAX_TOKENS, MIN_CHARS, MARGIN = 10, 6, 24

#: The patterns of the base kinds, with possessive or anchored forms where the plain ones are quadratic.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        # The leftmost start before this sign is that of the run of local characters, not before the last match's end.
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = t.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    t = text or ""
    out = [(a, 0, b) for a, b in _emails(t)]
    if not re.search("[0-9]", t):
        return out
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field

#: Words joined by signs, with the padding of what is written to base 64; or one sign.
_TOKEN = re.compile(r"[^\W_]+(?:[-_/+.~@!#$%&*^]+[^\W_]+)*(?:(?<=[A-Za-z0-9+/]{16})={1,2}(?![^\s\"'.,;)]))?|[^\w\s]|_")
#: What only joins the words of secrets.
_ODD = re.compile(r"[~@!#$%&*^+]")
LABELS = (None, 4, 5, 0, 1, 2, 3)  # other, secret, id, then the base kinds
_KEYWORDS = {
    "password": "pw", "passwd": "pw", "pwd": "pw", "passphrase": "pw", "secret": "pw", "token": "pw", "key": "pw", "apikey": "pw", "bearer": "pw", "credential": "pw",
    "ssn": "id", "iban": "id", "passport": "id", "license": "id", "licence": "id", "account": "id", "vat": "id",
}
#: Between a keyword and what it names.
_FILLERS = frozenset("number no nr num is was code value".split())
_WORD = re.compile(r"(?<![^\W_])(?:" + "|".join(_KEYWORDS) + r")(?![^\W_])", re.I)
_MIXED = re.compile(r"[A-Z](?:(?<=[a-z][A-Z])|(?=[A-Z][a-z]))")
_DIGIT = re.compile("[0-9]")
#: How many tokens before a segment its word before may stand.
_BEFORE = 4

Edge = tuple[int, int, list[str]]  # start, label or -1 (secret or id), features


def tokens(t: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a text, cut at the ends of its base spans."""
    cuts, at, out = sorted({x for a, _, b in base for x in (a, b)}), 0, []
    for cut in [*cuts, len(t)]:
        out += [m.span() for m in _TOKEN.finditer(t, at, cut)]
        at = cut
    return out


def _after(t: str, toks: list[tuple[int, int]], i: int) -> str | None:
    """The nearest word before token i, over a few signs and fillers: its keyword class, else "word"; None without one."""
    k, filled = i - 1, False
    while k >= 0 and i - k <= _BEFORE:
        a, b = toks[k]
        if t[a].isalnum():
            # Of words that signs join the last names what follows.
            word = re.split(r"[\W_]+", t[max(a, b - 24) : b])[-1].lower()
            if word not in _FILLERS:
                return _KEYWORDS.get(word, "word")
            filled = True
        k -= 1
    return "word" if filled else None


def _features(t: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the segment of tokens i..j-1 as a whole."""
    a, b = toks[i][0], toks[j - 1][1]
    s = t[a:b]
    core = [c for c in s if c.isalnum()]
    n, dig, up = len(core), sum(c.isdigit() for c in core), sum(c.isupper() for c in core)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in core)
    f = ["bias", f"len{min(10, n // 4)}", f"toks{min(4, j - i)}", f"dig{int(4 * dig / max(1, n))}"]
    if dig == n:
        f.append("alldig")
    elif not dig:
        f.append("mixedcase" if _MIXED.search(s) else "alpha")
        f.append(f"alpha{min(5, n // 4)}")
    elif hexa == n and n >= 16:
        f.append("hex")
    elif n >= 12:
        f.append("mixed")
    if up + dig == n and up and n >= 16:
        f.append("upper")
    parts = [x for x in re.split(r"[\W_]+", s) if x] if not any(c.isspace() for c in s) else []
    if len(parts) > 1:
        f += [f"parts{min(4, len(parts))}", f"part{min(5, n // len(parts) // 3)}"]
        if re.fullmatch(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", s):
            f.append("uuid")
        if _ODD.search(s):
            f.append("odd")
        if "/" in s and all(len(x) < 12 for x in parts):
            f.append("path")
        if not dig and not up:
            f.append("words")
    if s[:4] in ("AKIA", "ASIA", "ghp_", "gho_", "xoxb", "sk-l", "sk_l", "glpa"):
        f.append("prefix")
    if re.fullmatch(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}", s):
        f.append("3-2-4")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", s):
        # Followed by one group more, it is cut short.
        more = j < len(toks) and toks[j][0] == b + 1 and t[b] == " " and re.fullmatch(r"[A-Z0-9]{1,4}", t[slice(*toks[j])])
        f.append("ibancut" if more else "iban")
    if any(c.isspace() for c in s):
        f.append("gap")
    if not (s[0].isalnum() and s[-1].isalnum()):
        f.append("edge")
    if any(not (c.isalnum() or c in " -_/+.") for c in s):
        f.append("signs")
    after, sign = _after(t, toks, i), "none"
    if after:
        f.append("after_" + after)
    if i:
        sign = t[toks[i - 1][0]] if t[toks[i - 1][0]] in "=:\"'#" else "x"
        f.append("sign_" + sign)
        if toks[i - 1][1] == a and t[a - 1].isalnum():
            f.append("glued")
    f.append(f"after_{after}_{sign}" + ("_alpha" if not dig else ""))
    if j < len(toks) and toks[j][0] == b and t[b] in "\"'":
        f.append("quoted")
    return f


def lattice(t: str, toks: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[list[Edge]]:
    """For each end the segments that may be an entity. base: base spans of t; those at token boundaries are segments of their kind."""
    size = [b - a for a, b in toks]
    digits = [sum("0" <= c <= "9" for c in t[a:b]) for a, b in toks]
    strong = [n >= MIN_CHARS and (d > 0 or _MIXED.search(t[a:b]) is not None) for n, d, (a, b) in zip(size, digits, toks, strict=True)]
    known = [_after(t, toks, i) in ("pw", "id") for i in range(len(toks))]
    odd = [n >= 4 and t[a].isalnum() and _ODD.search(t, a, b) is not None for n, (a, b) in zip(size, toks, strict=True)]
    out: list[list[Edge]] = [[] for _ in range(len(toks) + 1)]
    for i in range(len(toks)):
        total, sure, long = 0, False, False
        for j in range(i + 1, min(i + MAX_TOKENS, len(toks)) + 1):
            total, sure, long = total + digits[j - 1], sure or strong[j - 1], long or size[j - 1] >= MIN_CHARS or odd[j - 1]
            if sure or total >= MIN_CHARS or (long and known[i]):
                out[j].append((i, -1, _features(t, toks, i, j)))
    starts, ends = {a: k for k, (a, _) in enumerate(toks)}, {b: k + 1 for k, (_, b) in enumerate(toks)}
    for a, kind, b in base:
        if a in starts and b in ends:
            out[ends[b]].append((starts[a], LABELS.index(kind, 1), _features(t, toks, starts[a], ends[b])))
    return out


def _labels(y: int) -> tuple[int, ...]:
    return (1, 2) if y < 0 else (y,)


def _score(w: dict[tuple[int, str], float], y: int, f: list[str]) -> float:
    return sum(w.get((y, x), 0.0) for x in f)


def _step(w: dict[tuple[int, str], float], p: int, y: int) -> float:
    return w.get((y, f"from{p}"), 0.0) if p else 0.0


def decode(t: str, toks: list[tuple[int, int]], w: dict[tuple[int, str], float], base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """The best segmentation's entities as (start, kind, end) in code points. Other tokens score 0 and are segments of one."""
    n, edges = len(toks), lattice(t, toks, base)
    best: list[dict[int, tuple[float, int, int]]] = [{0: (0.0, 0, 0)}]  # label of the last segment -> score, its start, label before
    for j in range(1, n + 1):
        p = max(best[j - 1], key=lambda q: best[j - 1][q][0])
        now = {0: (best[j - 1][p][0], j - 1, p)}
        for i, kind, f in edges[j]:
            for y in _labels(kind):
                own = _score(w, y, f)
                for p, (s, _, _) in best[i].items():
                    s += own + _step(w, p, y)
                    if y not in now or s > now[y][0]:
                        now[y] = (s, i, p)
        best.append(now)
    out, j = [], n
    y = max(best[n], key=lambda q: best[n][q][0])
    while j:
        _, i, p = best[j][y]
        if y:
            out.append((toks[i][0], LABELS[y], toks[j - 1][1]))
        j, y = i, p
    return out[::-1]


def _sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def _train(rounds: int = 6, rate: float = 0.4, l2: float = 1e-3, sentences: int = 640) -> dict[tuple[int, str], float]:
    """Maximum likelihood by stochastic gradient over made sentences: observed less expected features."""
    rng, w = random.Random(11), {}
    data = []
    for t, spans in _made(rng, sentences):
        base = base_spans(t)
        toks = tokens(t, base)
        starts, ends = {a: k for k, (a, _) in enumerate(toks)}, {b: k + 1 for k, (_, b) in enumerate(toks)}
        gold = {(starts[a], ends[b], y) for a, b, y in spans if a in starts and b in ends}
        gold |= {(starts[a], ends[b], LABELS.index(k, 1)) for a, k, b in base if a in starts and b in ends}
        data.append((len(toks), lattice(t, toks, base), gold))
    for r in range(rounds):
        rng.shuffle(data)
        step = rate / (1 + 0.3 * r)
        for n, edges, gold in data:
            arcs = [[(i, y, f, _score(w, y, f)) for i, kind, f in edges[j] for y in _labels(kind)] for j in range(n + 1)]
            fwd: list[dict[int, float]] = [{0: 0.0}]
            for j in range(1, n + 1):
                into = {0: list(fwd[j - 1].values())}
                for i, y, _, s in arcs[j]:
                    into.setdefault(y, []).extend(v + s + _step(w, p, y) for p, v in fwd[i].items())
                fwd.append({y: _sum(v) for y, v in into.items()})
            heads: list[dict[tuple[int, int], float]] = [{} for _ in range(n + 1)]
            out_of: list[list[tuple[int, int, list[str], float]]] = [[] for _ in range(n + 1)]
            for j in range(n + 1):
                for i, y, f, s in arcs[j]:
                    out_of[i].append((j, y, f, s))
            bwd: list[dict[int, float]] = [{} for _ in range(n + 1)]
            bwd[n] = dict.fromkeys(fwd[n], 0.0)
            for i in range(n - 1, -1, -1):
                for p in fwd[i]:
                    bwd[i][p] = _sum([bwd[i + 1][0], *(s + _step(w, p, y) + bwd[j][y] for j, y, _, s in out_of[i])])
            z = bwd[0][0]
            for i in range(n):
                for j, y, f, s in out_of[i]:
                    prob = 0.0
                    for p, v in fwd[i].items():
                        q = math.exp(min(0.0, v + s + _step(w, p, y) + bwd[j][y] - z))
                        prob += q
                        if p and q > 1e-4:
                            heads[i][p, y] = heads[i].get((p, y), 0.0) - q
                    g = ((i, j, y) in gold) - prob
                    if abs(g) > 1e-4:
                        for x in f:
                            w[y, x] = w.get((y, x), 0.0) * (1 - step * l2) + step * g
            last = {}
            for i, j, y in sorted(gold):
                if i in last:
                    heads[i][last[i], y] = heads[i].get((last[i], y), 0.0) + 1
                last[j] = y
            for h in heads:
                for (p, y), g in h.items():
                    w[y, f"from{p}"] = w.get((y, f"from{p}"), 0.0) + step * g
    return {k: round(v, 6) for k, v in sorted(w.items())}


def _made(rng: random.Random, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(start, end, label)]) with secrets and ids in many forms among plain words and numbers, and base kinds without labels."""
    words = "the of and on this that with report value order from total in house see for page note about version run item release garden holder general".split()
    plainer = "required please value string update missing changed policy store garden holder open closed never always point number word".split()
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    low = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    digits = lambda k: pick("0123456789", k)

    def secret() -> tuple[str, str]:
        h = pick(hexa, rng.choice((16, 18, 20, 24, 32, 40)))
        h = h if any(c.isdigit() for c in h) else h[:-1] + "7"
        long = pick(alnum + alnum.lower(), rng.choice((20, 28, 36)))[:-1] + rng.choice("3579")
        phrase = pick(low, rng.randint(14, 26))
        case = "".join(c.upper() if rng.random() < 0.5 else c for c in pick(low, rng.randint(18, 32)))
        short = pick(low, rng.randint(5, 8)) + digits(rng.randint(2, 4))
        uuid = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        mixed = alnum + alnum.lower() + "0189"
        cut = rng.choice("/+") .join(pick(mixed, k) for k in (rng.randint(8, 14), rng.randint(5, 9), rng.randint(12, 18)))
        three = ".".join(pick(mixed, k) + rng.choice(("_", "-", "")) + pick(mixed, k) for k in (9, rng.randint(10, 20), 14))
        sign = rng.choice("!@#$%&*^~").join((pick(low, rng.randint(1, 4)), pick(low, rng.randint(2, 5)) + rng.choice(("", digits(1)))))
        lead = rng.choice(("password=", "password: ", "passwd=", "pwd: ", "secret: ", "secret=", "passphrase: ", "Password: ", "credential: "))
        tail = rng.choice(('token = "', "token=", "api key: ", "bearer ", "api_key='", "token: ", "secret ", "key="))
        if rng.random() < 0.4:
            return rng.choice([(lead, uuid), (tail, uuid), (tail, cut), (lead, cut), (tail, cut + "="), (tail, three), ("", three), (lead, sign), (lead, sign)])
        return rng.choice([(lead, h), (tail, h), (lead, phrase), (lead, phrase), (lead, short), (tail, long), (tail, long), (tail, case), ("", h), ("", "AKIA" + pick(alnum, 15) + "5"), ("", "ghp_" + pick(alnum + alnum.lower(), 35) + "4")])

    def number() -> tuple[str, str]:
        iban = f"{pick('DEFRSGB', 2)}{digits(2)}" + "".join(" " + digits(4) for _ in range(4))
        letters = f"{pick('MTLCNO', 2)}{digits(2)} {pick('MALTBCY', 4)}" + "".join(" " + pick("0123456789CLMT", 4) for _ in range(rng.randint(4, 5))) + " " + digits(2) + pick("STU", 1)
        if rng.random() < 0.25:
            return rng.choice([("iban ", letters), ("IBAN: ", letters), ("", letters), ("passport number ", pick("CFGHJK", 1) + digits(8)), ("passport no. ", pick("CFGHJK", 1) + digits(8)), ("account number is ", digits(rng.randint(8, 11))), ("license number: ", pick("ABCDE", 1) + digits(7))])
        ssn = rng.choice("- ").join((digits(3), digits(2), digits(4)))
        return rng.choice([("ssn ", ssn), ("SSN: ", ssn), ("ssn ", digits(9)), ("", f"{digits(3)}-{digits(2)}-{digits(4)}"), ("iban ", iban), ("", iban.replace(" ", "")), ("passport ", pick("CFGHJK", 1) + digits(8)), ("passport: ", pick("CFGHJK", 2) + digits(7)), ("account ", digits(rng.randint(8, 11))), ("license: ", pick("ABCDE", 1) + digits(7)), ("vat ", pick("DEFRGB", 2) + digits(9))])

    def plain() -> str:
        key = rng.choice(sorted(_KEYWORDS))
        return rng.choice([
            f"2.{digits(1)}", digits(4), f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"{digits(3)},{digits(3)}.{digits(2)}", f"order {digits(7)}", f"page {digits(6)}", f"total {digits(8)}", f"isbn 978{digits(10)}", f"v{digits(6)}", f"item{digits(5)}",
            f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{key} {rng.choice(words)} {rng.choice(plainer)}", f"{key}: {rng.choice(plainer)}", f"the {key} {rng.choice(plainer)}", f"{key} is {rng.choice(plainer)}",
            f"{pick(low, 6)}@{pick(low, 7)}.com", f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", f"{pick(low, 4).title()}{pick(low, 5).title()}", f"{pick(low, 5)}{pick(low, 6).title()}", f"{pick(low, 3).upper()}{pick(low, 6)}", pick(low, rng.randint(14, 22)), f"server {pick(low, 5)}{digits(2)}",
            "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f"{pick(low, 6)}.{pick(low, 3)}/{pick(low, 7)}/{digits(3)}.html", f"https://{pick(low, 8)}.org/{pick(low, 5)}/{digits(4)}", f"{pick(low, 5)}-{pick(low, 4)}-{pick(low, 7)}", f"{pick(low, 6).title()}-{pick(low, 7).title()}", f"{pick(low, 5)}/{pick(low, 6)}", f"{digits(4)}/{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(1)}",
            f"{pick(low, 4)}_{pick(low, 5)}_{digits(2)}", f"{pick(low, 3)}.{pick(low, 6)}()", f"{rng.choice(words)}.{rng.choice(words).title()}", f"{pick(low, 1).upper()}&{pick(low, 1).upper()}", f"{key} number {rng.choice(words)}", f"{key}-{rng.choice(words)}", f"covid-{digits(2)}-{pick(low, 7)}", f"{digits(2)}%-{pick(low, 4)}",
        ])

    for _ in range(n):
        t, spans = "", []
        for _ in range(rng.randint(2, 4)):
            t += " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + " "
            x = rng.random()
            if x < 0.45:
                y, (lead, s) = (1, secret()) if x < 0.27 else (2, number())
                spans.append((len(t) + len(lead), len(t) + len(lead) + len(s), y))
                t += lead + s + (lead[-1] if lead.endswith(('"', "'")) else "") + rng.choice((" ", ". ", ", "))
            else:
                t += plain() + rng.choice((" ", ". "))
        yield t.strip(), spans


@lru_cache(1)
def model() -> dict[tuple[int, str], float]:
    """The trained weights; the same in every run."""
    return _train()


def _triggers(t: str) -> list[int]:
    """Where digits, changes of case and keywords stand, in order."""
    at = [m.start() for m in _DIGIT.finditer(t)] + [m.start() for m in _MIXED.finditer(t)]
    low = t.lower()
    if any(k in low for k in _KEYWORDS):
        at += [m.start() for m in _WORD.finditer(t)]
    return sorted(at)


def windows(t: str, base: list[tuple[int, int, int]] = ()) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, tokens) of the stretches that may hold entities: MARGIN tokens around each digit, change of case, keyword and base span, near ones as one."""
    marks = sorted({*_triggers(t), *(a for a, _, _ in base), *(b - 1 for _, _, b in base)})
    if not marks:
        return
    toks = tokens(t, base)
    begins = [a for a, _ in toks]
    first = last = None  # of the stretch at hand
    # A base span of many tokens has a mark at both ends only; it is one stretch with them.
    held = sorted({k for m in marks if (k := bisect_right(begins, m) - 1) >= 0} | {k for a, _, b in base for k in range(bisect_left(begins, a), bisect_left(begins, b))})
    for k in held:
        if last is not None and k - MARGIN > last + MARGIN:
            yield toks[first][0], toks[last + MARGIN][1], toks[first : last + MARGIN + 1]
            first = None
        first, last = max(0, k - MARGIN) if first is None else first, k
    if last is not None:
        end = min(len(toks), last + MARGIN + 1)
        yield toks[first][0], toks[end - 1][1], toks[first:end]


def added_spans(text: str | None, base: list[tuple[int, int, int]], w: dict[tuple[int, str], float]) -> list[tuple[int, int, int]]:
    """What the field adds, as (start, kind's place, end)."""
    t = text or ""
    out, n = [], 0
    by_start = sorted(base)
    for a, b, toks in windows(t, base):
        while n < len(by_start) and by_start[n][0] < a:
            n += 1
        own, k = [], n
        while k < len(by_start) and by_start[k][0] < b:
            own.append(by_start[k])
            k += 1
        out += [x for x in decode(t, toks, w, own) if x[1] > 3]
    taken, free, k = sorted((s, e) for s, _, e in base), [], 0
    longest = max((e - s for s, e in taken), default=0)
    for x, y, z in out:
        while k < len(taken) and taken[k][0] <= x - longest:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < z and taken[i][1] <= x:
            i += 1
        if i == len(taken) or taken[i][0] >= z:
            free.append((x, y, z))
    return free


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added and n_spans (all) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            counts, sha, spans, more, both = [[], [], [], []], [], [], [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                extra = added_spans(t, base, w)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(sorted([*base, *extra])))
                more.append(len(extra))
                both.append(len(base) + len(extra))
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans), pa.array(more, pa.int64()), pa.array(both, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans the first, longest counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    at = docs.columns.index("text")

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        base = base_spans(t)
        out, done = [], 0
        for a, k, b in sorted([*base, *added_spans(t, base, shared.value)], key=lambda s: (s[0], -s[2])):
            if a >= done:
                out += [t[done:a], f"<{KINDS[k]}>"]
                done = b
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
