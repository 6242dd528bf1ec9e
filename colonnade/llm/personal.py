"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds the spans which patterns miss."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")

# Possessive, so that no text makes a pattern go back over a long run; what they find is what the plain patterns find.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ to the left over the letters that a name may have, and to the right over a domain."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of the fixed patterns that pass their check, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# Where spans can lie: stretches of numbers, surroundings of written-out at signs, groups of hexadecimal digits.
NUMBERS = re.compile(r"[+(]{0,2}+[0-9](?:[\x20()./+-]{0,3}+[0-9]++)*+")
AT = re.compile(r"@|[\[({<]\x20?(?:at|ät|arroba|arobase)\x20?[\])}>]|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)", re.I)
GROUPS = re.compile(r"(?<![0-9A-Za-z.])(?<![0-9A-Fa-f:]:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
DOT = r"(?:\x20?\.\x20?|\x20?[\[({<]\x20?(?:dot|punkt|punto|point)\x20?[\])}>]\x20?|\x20dot\x20)"
ADDRESS = re.compile(rf"(?P<local>[a-z0-9](?:[a-z0-9._%+-]|{DOT}(?=[a-z0-9])){{0,60}})(?P<at>\x20?@\x20?|\x20?[\[({{<]\x20?(?:at|ät|arroba|arobase)\x20?[\])}}>]\x20?|\x20at\x20)"
                     rf"(?P<domain>[a-z0-9-]{{1,63}}(?:{DOT}[a-z0-9-]{{1,63}}){{0,4}}{DOT}(?P<last>[a-z]{{2,12}}))", re.I)
BEFORE, AFTER, LONGEST = 64, 120, 60  # characters around an at sign; tokens of a span
SLOTS = 1 << 12

CUES = {
    "phone": "phone telephone tel fax mobile cell call dial whatsapp sms telefon handy anruf téléphone portable appelez teléfono móvil llamar",
    "card": "card visa mastercard amex credit debit karte kreditkarte carte bancaire tarjeta crédito cc",
    "email": "mail email e-mail contact write kontakt schreiben courriel écrire correo escribir",
    "ip": "ip ipv6 host server address client gateway dns adresse serveur servidor",
    "other": "order isbn invoice id no nr number serial commit version date ref sku tracking account iban bestellung rechnung commande facture pedido factura build zip plz since year page",
}
CUE = {w: kind for kind, words in CUES.items() for w in words.split()}
COMMON_ENDS = frozenset("com org net edu gov io info de fr es uk eu".split())


def islands(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Tokens (start, end) of every stretch of text that can hold a span, none of them inside `taken`.

    A span has seven digits in one stretch of numbers, an at sign, or colons between hexadecimal groups. All other text can only lie outside
    spans, at no cost, so the best choice over the whole text is that of its islands together."""
    found = [m.span() for m in NUMBERS.finditer(text) if m.end() - m.start() >= 7 and len(_digits(m.group())) >= 7]
    covered = {text.find("@", s, e) for s, e in taken}
    for m in AT.finditer(text):
        if m.start() not in covered:
            found.append((max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)))
    if "::" in text or text.count(":") > 6:
        found += [m.span() for m in GROUPS.finditer(text) if m.end() > m.start() + 7]
    merged: list[list[int]] = []
    for s, e in sorted(found):
        while s and text[s - 1].isalnum() and text[s].isalnum():  # whole tokens
            s -= 1
        while e < len(text) and text[e - 1].isalnum() and text[e].isalnum():
            e += 1
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, held = [], sorted(taken, reverse=True)
    for s, e in merged:
        part: list[tuple[int, int]] = []
        for m in TOKEN.finditer(text, s, e):
            while held and held[-1][1] <= m.start():
                held.pop()
            if held and held[-1][0] < m.end():
                if part:
                    out.append(part)
                part = []
            else:
                part.append(m.span())
        if part:
            out.append(part)
    return out


def _numbers(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    for i, (s, e) in enumerate(tokens):
        c = text[s]
        after = text[tokens[i + 1][0]] if i + 1 < len(tokens) else ""
        if not ("0" <= c <= "9" or (c in "+(" and (after.isdigit() or (c == "(" and after == "+")))):
            continue
        groups = digits = gap = 0
        seps = ""
        for j in range(i, len(tokens)):
            t = text[tokens[j][0]:tokens[j][1]]
            if "0" <= t[0] <= "9":
                groups, digits, gap = groups + 1, digits + len(t), 0
                if groups > 7 or digits > 19:
                    break
                if 7 <= digits <= 15 and digits >= groups + 2:
                    yield "phone", i, j + 1
                if 13 <= digits and groups <= 5 and c not in "+(" and not set(seps) & set("()/"):
                    yield "card", i, j + 1
                if groups == 4 and seps == "..." and all(map(_small, text[s:tokens[j][1]].split("."))):
                    yield "ip", i, j + 1
            elif t in " ()./-" or (t == "+" and (j == i or (j == i + 1 and c == "("))):
                gap += 1
                seps += t
                if gap > 3 and j > i + 2:
                    break
            else:
                break


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, first token, token after) of every segment that may be a span of the kind; the bound on its length makes the choice linear."""
    out = list(_numbers(text, tokens))
    begins, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    own = text[tokens[0][0]:tokens[-1][1]]
    if AT.search(own):
        for i, (s, _) in enumerate(tokens):
            if text[s].isalnum() and ADDRESS.match(text, s, tokens[-1][1]):
                for j in range(i, min(i + LONGEST, len(tokens))):
                    e = tokens[j][1]
                    if text[e - 1].isalpha() and ADDRESS.fullmatch(text, s, e):
                        out.append(("email", i, j + 1))
    for m in GROUPS.finditer(text, tokens[0][0], tokens[-1][1]):
        if m.start() in begins and m.end() in ends and re.search("[0-9]", m.group()):
            try:
                IPv6Address(m.group())
            except ValueError:
                continue
            out.append(("ip", begins[m.start()], ends[m.end()]))
    return out


def _side(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Slots of what is true of a whole span: its shape, digits, checks, marks, both sides and the words before it."""
    own, left, right = text[start:end], text[max(0, start - 40):start], text[end:end + 4]
    names = [f"left {_side(left[-1:])}", f"right {_side(right[:1])}", f"left two {_side(left[-2:-1])}{_side(left[-1:])}", f"right two {_side(right[:1])}{_side(right[1:2])}"]
    cues = [CUE[w] for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", left.lower())[-3:] if w in CUE]
    names += [f"cue {c}" for c in set(cues)] or ["no cue"]
    names += [f"near cue {cues[-1]}" if cues else "no near cue", "bias"]
    if kind == "email":
        m = ADDRESS.fullmatch(own)
        names += [f"at {re.sub('[a-zä]+', 'w', m['at'].lower())}", f"dots {re.sub('[a-z0-9-]+', 'w', m['domain'].lower())}", f"end {m['last'].lower() in COMMON_ENDS}",
                  f"local {' ' in m['local']} {any(map(str.isdigit, m['local']))}", f"local is a cue {m['local'].lower() in CUE}",
                  f"goes on {bool(re.match(DOT + '[a-z0-9]', text[end:end + 12], re.I))}", f"before {left[-1:] in LOCAL} {bool(re.search(DOT + '$', left, re.I))}"]
    elif ":" in own:
        names += [f"groups {own.count(':')}", f"gap {'::' in own}", f"letters {bool(re.search('[a-fA-F]', own))}"]
    else:
        digits = _digits(own)
        shape = re.sub("[0-9]+", lambda g: str(len(g.group())), own)
        marks = "".join(sorted(set(re.sub("[0-9]", "", own))))
        glued = bool(re.search(r"[0-9][ ()./-]{0,2}$", left)) and not own.startswith("+")
        goes_on = bool(re.match(r"[ ()./-]{0,2}[0-9]", right))
        good = luhn(digits)
        names += [f"shape {shape}", f"marks {marks}", f"digits {len(digits)}", f"luhn {good} {len(digits) >= 13}", f"plus {own.startswith('+')} {'(' in own}",
                  f"glued {glued} {goes_on}", f"first {digits[:1]} luhn {good}", f"first two {digits[:2] in ('34', '37')} luhn {good} {len(digits)}",
                  f"cue {' '.join(sorted(set(cues)))} plus {own.startswith('+')} marks {marks}", f"luhn {good} digits {len(digits)} sizes {len(set(re.findall('[0-9]+', shape)))}",
                  f"date {bool(re.fullmatch('(1|2|4)[./-](1|2)[./-](1|2|4)( .*)?', shape))}", f"open {own.count('(') - own.count(')')}",
                  f"plus {own.startswith('+')} digits {len(digits)} goes on {goes_on}", f"zero {digits[:1] == '0'} marks {marks}",
                  f"goes on with a plus {bool(re.match('[ ]?[+]', right))}", f"one kind of digit {len(set(digits)) < 3}"]
    return [crc32(f"{kind} {n}".encode()) % SLOTS for n in names]


class Field:
    """Weights of the span features by slot, and of a segment's kind after the one before it; 0 stands for text outside spans."""

    def __init__(self):
        self.weight, self.after = np.zeros(SLOTS), np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def score(self, slots: list[int]) -> float:
        return float(self.weight[slots].sum())

    def best(self, count: int, spans: list[tuple[int, int, int]], scores: list[float]) -> list[int]:
        """Numbers of the spans (kind from 1, first token, token after) of the segmentation of `count` tokens with the largest score."""
        after, by_end = self.after.tolist(), {}
        for i, (_, _, end) in enumerate(spans):
            by_end.setdefault(end, []).append(i)
        value = [[0.0] + [-np.inf] * len(KINDS)]
        back: list[list[tuple[int, int] | None]] = [[None] * (len(KINDS) + 1)]
        for end in range(1, count + 1):
            now, from_ = [-np.inf] * (len(KINDS) + 1), [None] * (len(KINDS) + 1)
            for i in [-1, *by_end.get(end, [])]:  # -1: one token outside
                kind, start, own = (0, end - 1, 0.0) if i < 0 else (spans[i][0], spans[i][1], scores[i])
                for before, v in enumerate(value[start]):
                    if v + after[before][kind] + own > now[kind]:
                        now[kind], from_[kind] = v + after[before][kind] + own, (i, before)
            value.append(now)
            back.append(from_)
        at, kind, chosen = count, int(np.argmax(value[-1])), []
        while at:
            i, before = back[at][kind]
            if i >= 0:
                chosen.append(i)
            at, kind = (at - 1 if i < 0 else spans[i][1]), before
        return chosen[::-1]

    def marginals(self, count: int, spans: list[tuple[int, int, int]], scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over all segmentations, probability of every span, and expected number of steps from kind to kind."""
        kinds = len(KINDS) + 1
        by_end, by_start = {}, {}
        for i, (_, start, end) in enumerate(spans):
            by_end.setdefault(end, []).append(i)
            by_start.setdefault(start, []).append(i)
        front, out = np.full((count + 1, kinds), -np.inf), np.empty((count + 1, kinds))
        front[0, 0] = 0
        for at in range(count + 1):
            if at:
                front[at, 0] = out[at - 1, 0]
                for i in by_end.get(at, []):
                    kind, start, _ = spans[i]
                    front[at, kind] = np.logaddexp(front[at, kind], out[start, kind] + scores[i])
            out[at] = np.logaddexp.reduce(front[at][:, None] + self.after, axis=0)
        total = float(np.logaddexp.reduce(front[count]))
        behind, chance, steps = np.full((count + 1, kinds), -np.inf), np.zeros(len(spans)), np.zeros((kinds, kinds))
        behind[count] = 0
        for at in range(count - 1, -1, -1):
            follow = np.full(kinds, -np.inf)  # by the kind of the next segment
            follow[0] = behind[at + 1, 0]
            for i in by_start.get(at, []):
                kind, _, end = spans[i]
                own = scores[i] + behind[end, kind]
                chance[i] = np.exp(out[at, kind] + own - total)
                follow[kind] = np.logaddexp(follow[kind], own)
            behind[at] = np.logaddexp.reduce(self.after + follow[None, :], axis=1)
            steps += np.exp(front[at][:, None] + self.after + follow[None, :] - total)
        return total, chance, steps


def examples(count: int = 1100, seed: int = 17) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts made from a seed: personal data in many forms, next to each other and to numbers of other kinds. Pass reviewed texts to
    `train` where there are some; the test tables have none."""
    r = random.Random(seed)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    d = lambda n: some(string.digits, n)
    word = lambda: some(string.ascii_lowercase + "éüñ", r.randint(2, 9))
    name = lambda: some(string.ascii_lowercase, r.randint(2, 9))
    cue = lambda kind: r.choice(CUES[kind].split()) + r.choice(["", ":", " ", ": ", " = "])

    def checked(n: int, head: str = "") -> str:
        body = (head or r.choice("3456")) + d(n - 1 - len(head or "x"))
        return next(body + x for x in string.digits if luhn(body + x))

    def unchecked(n: int) -> str:
        out = d(n)
        return out if not luhn(out) else out[:-1] + str((int(out[-1]) + 1) % 10)

    def cut(digits: str, sizes: list[int], sep: str) -> str:
        at = np.cumsum([0, *sizes])
        return sep.join(digits[i:j] for i, j in zip(at, at[1:]))

    def phone() -> tuple[str, str, str]:
        abroad = [lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(2)} {d(4)} {d(4)}",
                  lambda: f"+{r.randint(10, 99)}{d(10)}", lambda: f"+{r.randint(10, 99)} (0) {d(3)} {d(7)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(10, 99)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]
        near = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(3)}/{d(6)}",
                lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"({d(3)}) {d(3)} {d(4)}"]
        if r.random() < 0.6:
            return r.choice([cue("phone"), "", ""]), r.choice(abroad)(), "phone"
        form = r.choice(near)
        return ("" if form is near[0] and r.random() < 0.5 else cue("phone")), form(), "phone"

    def card() -> tuple[str, str, str]:
        c = r.random()
        if c < 0.5:
            return r.choice([cue("card"), "", ""]), checked(16), "card"
        if c < 0.8:
            return r.choice([cue("card"), ""]), cut(checked(16), [4, 4, 4, 4], r.choice([" ", "-", ".", "  "])), "card"
        return cue("card"), r.choice([lambda x: x, lambda x: cut(x, [4, 6, 5], r.choice([" ", "-"]))])(checked(15, r.choice(["34", "37"]))), "card"

    def email() -> tuple[str, str, str]:
        local, host, last = name() + r.choice(["", d(2), "." + name()]), name() + r.choice(["", d(1)]), r.choice(["com", "org", "de", "net", "fr", "es"])
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "), (" @ ", "."), ("@", "."), (" (at) ", "."), ("{at}", "{dot}"), ("@ ", " . "), ("@", " [dot] ")])
        return r.choice([cue("email"), "", ""]), local + at + host + r.choice(["", dot + name()]) + dot + last, "email"

    def ip() -> tuple[str, str, str]:
        if r.random() < 0.5:
            return r.choice([cue("ip"), ""]), ".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"
        groups = [some("0123456789abcdef", r.randint(1, 4)) for _ in range(8)]
        return r.choice([cue("ip"), ""]), r.choice([":".join(groups), "2001:db8::" + d(2), "fe80::" + some("123456789abcdef", 4) + ":" + d(3)]), "ip"
    other = [
        lambda: (r.choice([cue("other"), ""]), unchecked(r.randint(5, 20)), ""), lambda: ("", unchecked(16), ""), lambda: (cue("other"), d(r.randint(7, 12)), ""),
        lambda: ("", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", ""), lambda: ("", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {d(2)}:{d(2)}:{d(2)}", ""),
        lambda: (cue("other"), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", ""), lambda: ("", f"{r.randint(1900, 2000)}-{r.randint(2000, 2030)} {r.randint(1900, 2000)}-{r.randint(2000, 2030)}", ""),
        lambda: ("", " ".join(f"{d(2)}.{d(2)}" for _ in range(r.randint(2, 6))), ""), lambda: ("", " ".join(d(r.randint(1, 5)) for _ in range(r.randint(2, 7))), ""),
        lambda: ("", f"{d(2)} {d(3)} {d(3)} {d(3)}", ""), lambda: (cue("other"), f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", ""),
        lambda: (r.choice(["token = \"", "sha ", ""]), "a" + some("0123456789abcdef" + string.digits * 3, r.randint(12, 40)) + "f", ""), lambda: ("", f"{d(1)}.{d(1)}.{d(2)}", ""),
        lambda: ("", f"v{d(1)}.{d(1)}.{d(1)}-{d(8)}", ""), lambda: ("", "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), ""), lambda: ("", f"{d(3)}-{d(2)}-{d(4)}", ""),
        lambda: ("", f"{name()} @ {name()}. {name().title()} {name()}", ""), lambda: ("", f"@{name()} {name()}.{name()}", ""), lambda: ("", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ""),
        lambda: ("", f"${d(3)},{d(3)}.{d(2)} {d(4)}", ""), lambda: (cue("other"), f"#{d(4)}-{d(6)}", ""), lambda: ("", f"{d(2)}.{d(3)}.{d(3)} {d(2)}", "")]
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 4)):
            before, value, kind = r.choice([phone, phone, card, card, email, ip, *r.sample(other, 6)])()
            text += r.choice([" ", " ", " ", ", ", ". ", "\n", "### ", " | "]) if text else ""
            text += before + (" " if before[-1:].isalpha() else "")
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
            if r.random() < 0.55:
                text += r.choice([" ", ", ", ". ", "%%% ", " | "]) + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Ascent on the likelihood of the labelled segmentations, with steps that shrink by slot."""
    field, order, ready = Field(), random.Random(seed), []
    for text, spans in labelled:
        for tokens in islands(text, []):
            own = candidates(text, tokens)
            numbered = [(KINDS.index(k) + 1, i, j) for k, i, j in own]
            places = [(k, tokens[i][0], tokens[j - 1][1]) for k, i, j in own]
            ready.append((len(tokens), numbered, [features(text, *p) for p in places], [n for n, p in enumerate(places) if p in set(spans)]))
    squares, steps_squared = np.full(SLOTS, 1e-3), np.full(field.after.shape, 1e-3)
    for _ in range(rounds):
        order.shuffle(ready)
        for count, spans, slots, right in ready:
            if not spans:
                continue
            _, chance, steps = field.marginals(count, spans, np.array([field.score(s) for s in slots]))
            wanted, at, before = np.zeros_like(steps), 0, 0
            for n in sorted(right, key=lambda n: spans[n][1]):
                for _ in range(at, spans[n][1]):
                    wanted[before, 0] += 1
                    before = 0
                wanted[before, spans[n][0]] += 1
                at, before = spans[n][2], spans[n][0]
            for _ in range(at, count):
                wanted[before, 0] += 1
                before = 0
            grad = np.zeros(SLOTS)
            for n, s in enumerate(slots):
                np.add.at(grad, s, (n in right) - chance[n])
            touched = np.flatnonzero(grad)
            squares[touched] += grad[touched] ** 2
            field.weight[touched] += rate * (grad[touched] / np.sqrt(squares[touched]) - decay * field.weight[touched])
            steps_squared += (wanted - steps) ** 2
            field.after += rate * ((wanted - steps) / np.sqrt(steps_squared) - decay * field.after)
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(examples())


def spans_of(text: str | None, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a fixed pattern found it) by kind and start. Spans that the field adds overlap no other."""
    base = base_spans(text or "")
    out = [(*b, True) for b in base]
    if text and (re.search("[0-9@]", text) or AT.search(text)):
        for tokens in islands(text, sorted({(s, e) for _, s, e in base})):
            own = candidates(text, tokens)
            if own:
                places = [(k, tokens[i][0], tokens[j - 1][1]) for k, i, j in own]
                chosen = field.best(len(tokens), [(KINDS.index(k) + 1, i, j) for k, i, j in own], [field.score(features(text, *p)) for p in places])
                out += [(*places[n], False) for n in chosen]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, in code points of the whole text.

    Null and empty texts have no spans; null keys and repeated rows are ordinary rows; no rows give no rows; further columns are ignored. Texts are
    read row by row, nothing is shuffled; the field (32 KB) travels with the function."""
    model = field or default_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "base": base} for k, s, e, base in spans_of(t, model)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "spans": found})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


@query("op11_semi_markov_field")
def op11_semi_markov_field(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the fixed patterns' spans, and all spans. SQL has no trained models."""
    found = find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
