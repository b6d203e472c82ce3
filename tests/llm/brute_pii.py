"""Personal values found and permuted in plain Python, one character after another."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

DIGITS = "0123456789"
#: Two-digit and one-digit telephone calling codes; all others have three.
SHORT_CODES = {1, 7, 20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86,
               *range(90, 96), 98}
TOKEN = re.compile(
    r"(gh[pousr]_|github_pat_|sk-|[sr]k_(?:live|test)_|xox[abeoprs]-|AIza|eyJ|AKIA)([^\s\"'`]*)"
)
LABEL = re.compile(
    r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"'`]?|bearer\s{1,3}", re.I
)
ENOUGH = {"sk-": (16, "_-"), "github_pat_": (16, "_"), "AIza": (30, "_-"), "AKIA": (16, "")}


def feistel(values, moduli, kind, tweak, key):
    half = len(values) // 2
    left, right = list(values[:half]), list(values[half:])
    for turn in range(10):
        own, other, first = (left, right, 0) if turn % 2 == 0 else (right, left, half)
        said = ",".join(map(str, other))
        new = []
        for j, x in enumerate(own):
            text = "|".join([key, kind, tweak, str(len(values)), str(turn), str(j), said])
            new.append((x + int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)) % moduli[first + j])
        left, right = (new, right) if turn % 2 == 0 else (left, new)
    return left + right


def permuted(text, free, kind, key, tweak="", other=-1):
    at = [i for i in range(len(text)) if free(i)]
    if not at:
        return text
    first = {i: 6 if i == other and text[i].islower() else 0 for i in at}
    numbers = [int(text[i]) if text[i] in DIGITS else ord(text[i].lower()) - 97 - first[i] for i in at]
    moduli = [10 if text[i] in DIGITS else 6 if i < other else 26 - first[i] for i in at]
    out = list(text)
    for i, n in zip(at, feistel(numbers, moduli, kind, tweak, key), strict=True):
        letter = chr(n + 97 + first[i]) if text[i] not in DIGITS else str(n)
        out[i] = letter.upper() if text[i].isupper() else letter
    return "".join(out)


def sign(c):
    return c.isascii() and c.isalnum()


def luhn(digits, doubled):
    from_right = [int(d) for d in reversed(digits)]
    return sum((2 * d - 9 * (d > 4)) if i % 2 == doubled else d for i, d in enumerate(from_right))


def mod97(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def card(v, key):
    digits = "".join(c for c in v if c in DIGITS)
    if luhn(digits, 1) % 10:
        return v
    new = permuted(v, lambda i: v[i] in DIGITS and 0 < i < len(v) - 1, "card", key, f"{v[0]},{len(digits)}")
    body = new[:-1]
    return body + str(-luhn([c for c in body if c in DIGITS], 0) % 10)


def iban(v, key):
    plain = v.replace(" ", "").upper()
    if mod97(plain) != 1:
        return v
    new = permuted(v, lambda i: i > 3 and sign(v[i]), "iban", key, plain[:2])
    bare = (new[:2] + "00" + new[4:]).replace(" ", "").upper()
    return f"{new[:2]}{98 - mod97(bare):02d}{new[4:]}"


def ipv4(v, key):
    octets = [int(x) for x in v.split(".")]
    return ".".join(map(str, feistel(octets, [256] * 4, "ipv4", "", key))) if max(octets) < 256 else v


def ssn(v, key):
    area, group, serial = (int(x) for x in v.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return v
    a, g, s = feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", "", key)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(v, key):
    digits = "".join(c for c in v if c in DIGITS)
    if v.startswith("+") and not v.startswith("+1"):
        width = next((n for n in (1, 2) if int(digits[:n]) in SHORT_CODES), 3)
        return permuted(v, lambda i: i > width and v[i] in DIGITS, "phone", key, v[: width + 1])
    places = [i for i, c in enumerate(v) if c in DIGITS][-10:]
    return permuted(v, lambda i: i in places, "nanp", key)


def date(v, key):
    parts = re.split(r"\D", v)
    iso = len(parts[0]) == 4

    def made(y, m, d):
        try:
            return dt.date(int(y), int(m), int(d))
        except ValueError:
            return None

    day_first, month_first = made(*parts[::-1]), made(parts[2], parts[0], parts[1])
    day = made(*parts) if iso else day_first or month_first
    if day is None or not 0 <= (n := (day - dt.date(1800, 1, 1)).days) < 189 * 773:
        return v
    a, b = feistel(divmod(n, 773), [189, 773], "date", "", key)
    new = dt.date(1800, 1, 1) + dt.timedelta(a * 773 + b)

    def field(number, like):
        return f"{number:02d}" if len(like) > 1 else str(number)

    if iso:
        out = [f"{new.year:04d}", field(new.month, parts[1]), field(new.day, parts[2])]
    elif day_first:
        out = [field(new.day, parts[0]), field(new.month, parts[1]), f"{new.year:04d}"]
    else:
        out = [field(new.month, parts[0]), field(new.day, parts[1]), f"{new.year:04d}"]
    return re.search(r"\D", v)[0].join(out)


def email(v, key):
    end = len(v) - len(re.search("[A-Za-z]+$", v)[0])
    return permuted(v, lambda i: sign(v[i]) and i < end, "email", key)


def secret(v, key):
    head = (m := LABEL.match(v)) and m[0] or ""
    if m := TOKEN.match(v[len(head) :]):
        head += m[1]
    rest, out = v[len(head) :], []
    for at in range(0, len(rest), 128):
        piece = rest[at : at + 128]
        other = next((i for i, c in enumerate(piece) if re.match("[A-Zg-z]", c)), len(piece))
        before = hashlib.sha256(rest[:at].encode()).hexdigest()
        tweak = f"{other},{at // 128},{before}"
        out.append(permuted(piece, lambda i, p=piece: sign(p[i]), "secret", key, tweak, other))
    return head + "".join(out)


def secret_at(text, at):
    """The end of a secret that starts at ``at``."""
    if m := LABEL.match(text, at):
        end = m.end()
        while end < len(text) and not re.match("[\\s\"'`]", text[end]):
            end += 1
        if end - m.end() >= 8:
            return end
    if m := TOKEN.match(text, at):
        if m[1] == "eyJ":
            jwt = re.compile(r"eyJ[\w-]{5,}\.[\w-]{5,}\.[\w-]*", re.A).match(text, at)
            return jwt and jwt.end()
        least, more = ENOUGH.get(m[1], (16 if m[1].startswith("gh") else 10 if "k_" in m[1] else 8, "-" if "xox" in m[1] else ""))
        run = re.match(f"[A-Za-z0-9{re.escape(more)}]*", m[2])[0]
        if m[1] == "AKIA":
            good = re.match(r"[0-9A-Z]{16}(?![A-Za-z0-9])", m[2])
            return at + 20 if good else None
        return at + len(m[1]) + len(run) if len(run) >= least else None
    return None


#: What the planted values look like, by kind; each is tried where no letter or digit stands before.
SHAPES = [
    (email, re.compile(r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    (iban, re.compile(r"[A-Za-z]{2}\d\d(?: ?[A-Za-z0-9]){8,30}(?![A-Za-z0-9])")),
    (date, re.compile(r"(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![-./]?\d)")),
    (ipv4, re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")),
    (ssn, re.compile(r"\d{3}-\d\d-\d{4}(?!-?\d)")),
    (phone, re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+1\d{10}(?!\d)")),
    (phone, re.compile(r"\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\.?\d)")),
    (card, re.compile(r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\.?\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)")),
]


def pseudonymised(text: str | None, key: str) -> tuple[str | None, int, int]:
    """New text, values found, values replaced; for texts whose values are parted by blanks."""
    if text is None:
        return None, 0, 0
    out, at, last, found, replaced = [], 0, 0, 0, 0
    while at < len(text):
        if at and sign(text[at - 1]):
            at += 1
            continue
        end, make = secret_at(text, at), secret
        numbers = not (at > 1 and text[at - 1] in "./-" and text[at - 2] in DIGITS)
        if m := SHAPES[0][1].match(text, at):
            end, make = m.end(), email
        elif not end:
            for make, shape in SHAPES[1:]:
                if (numbers or make is iban) and (m := shape.match(text, at)):
                    end = m.end()
                    if make is iban:  # as long as it is valid
                        ends = [e for e in range(end, at + 11, -1) if sign(text[e - 1]) and not sign(text[e : e + 1] or " ")]
                        end = next((e for e in ends if iban(text[at:e], key) != text[at:e]), None)
                        if end is None:
                            continue
                    break
            else:
                end = None
        if end:
            new = make(text[at:end], key)
            found, replaced = found + 1, replaced + (new != text[at:end])
            out += [text[last:at], new]
            at = last = end
        else:
            at += 1
    return "".join([*out, text[last:]]), found, replaced
