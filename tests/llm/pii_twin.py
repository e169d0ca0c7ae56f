"""op10 in plain Python, value by value."""

import datetime
import hashlib
import re

from leafmill.llm.pii import FORMATS, PATTERN


def _noise(key, kind, i, value):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16)


def permute(value, left, right, key, kind):
    a, b = divmod(value, right)
    for i in range(8):
        if i % 2:
            b = (b + _noise(key, kind, i, a)) % right
        else:
            a = (a + _noise(key, kind, i, b)) % left
    return a * right + b


def permute_digits(digits, key, kind):
    half = len(digits) // 2
    sides = [digits[:half], digits[half:]]
    for i in range(8):
        own, other = sides[i % 2], sides[1 - i % 2]
        if own:
            size = 10 ** len(own)
            sides[i % 2] = str((int(own) + _noise(key, kind, i, other)) % size).zfill(len(own))
    return "".join(sides)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


def mod97(chars):
    return int("".join(str(int(c, 36)) for c in chars)) % 97


def refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def _card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    body = permute_digits(d[:-1], key, "card")
    return refill(m, body + str(-luhn(body + "0") % 10))


def _iban(m, key):
    plain = m.replace(" ", "")
    if len(plain) > 34 or not "02" <= plain[2:4] <= "98" or mod97(plain[4:] + plain[:4]) != 1:
        return m
    digits = permute_digits(re.sub("[^0-9]", "", plain[4:]), key, "iban")
    return refill(m, f"{98 - mod97(refill(plain[4:], digits) + plain[:2] + '00'):02d}" + digits)


def _ip(m, key):
    parts = [int(p) for p in m.split(".")]
    if max(parts) > 255:
        return m
    n = permute(int.from_bytes(bytes(parts), "big"), 65536, 65536, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(m, key):
    d = re.sub("[^0-9]", "", m)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    areas = [k for k in range(1, 900) if k != 666]
    odd = [0, 666, *range(900, 1000)]
    if area in odd:
        q, r = divmod(permute(odd.index(area) * 10**6 + int(d[3:]), 102, 10**6, key, "ssn area"), 10**6)
        return refill(m, f"{odd[q]:03d}{r:06d}")
    if not group:
        q, r = divmod(permute(areas.index(area) * 10**4 + serial, 898, 10**4, key, "ssn group"), 10**4)
        return refill(m, f"{areas[q]:03d}00{r:04d}")
    if not serial:
        q, r = divmod(permute(areas.index(area) * 99 + group - 1, 898, 99, key, "ssn serial"), 99)
        return refill(m, f"{areas[q]:03d}{r + 1:02d}0000")
    q, r = divmod(permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"), 9999)
    return refill(m, f"{areas[q // 99]:03d}{q % 99 + 1:02d}{r + 1:04d}")


def _phone(m, key):
    every = re.sub("[^0-9]", "", m)
    d = every[-10:]
    area, office, rest = int(d[:3]), int(d[3]), int(d[4:])
    if area < 200:
        new = f"{permute(int(d), 2000, 10**6, key, 'phone area'):010d}"
    else:
        first, n, kind = (0, 2, "phone office") if office < 2 else (2, 8, "phone")
        q, r = divmod(permute(((area - 200) * n + office - first) * 10**6 + rest, 800 * n, 10**6, key, kind), 10**6)
        new = f"{q // n + 200}{q % n + first}{r:06d}"
    return refill(m, every[:-10] + new)


def _date(m, key):
    first = datetime.date(1900, 1, 1)
    try:
        day = (datetime.date.fromisoformat(m) - first).days
    except ValueError:
        return m
    return str(first + datetime.timedelta(permute(day, 17, 4297, key, "date")))


def _mail(m, key):
    name, host = m.split("@")
    codes = [(int(c), 10) if c.isdigit() else (ord(c) - 97, 26) for c in re.findall("[a-z0-9]", name.lower())]
    half = len(codes) // 2
    sides = [codes[:half], codes[half:]]
    for i in range(8):
        said = ",".join(f"{v}/{n}" for v, n in sides[1 - i % 2])
        seed = hashlib.sha512(f"{key}|mail|{i}|{said}".encode()).hexdigest()
        sides[i % 2] = [((v + int(seed[4 * j : 4 * j + 4], 16)) % n, n) for j, (v, n) in enumerate(sides[i % 2])]
    moved = iter(sides[0] + sides[1])
    out = ""
    for c in name:
        if re.match("[A-Za-z0-9]", c):
            v, n = next(moved)
            s = str(v) if n == 10 else chr(97 + v)
            c = s.upper() if c.isupper() else s
        out += c
    return f"{out}@{host}"


KINDS = {"mail": _mail, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def one(m, key):
    for kind, new in KINDS.items():
        if re.fullmatch(FORMATS[kind], m):
            return new(m, key)
    return m


def text(t, key):
    """The text with its values replaced, and how many are other than before."""
    count = 0

    def change(found):
        nonlocal count
        new = one(found[0], key)
        count += new != found[0]
        return new

    return (None, 0) if t is None else (re.sub(PATTERN, change, t), count)
