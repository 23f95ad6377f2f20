"""Brute-force versions of the operators, in plain Python over small tables."""

import hashlib
import math
import re
import zlib

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.A)
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", re.A)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+", re.A)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def digits(value):
    return [int(c) for c in value if "0" <= c <= "9"]


def luhn(found):
    total = 0
    for place, digit in enumerate(reversed(found)):
        if place % 2:
            digit = digit * 2 - 9 * (digit > 4)
        total += digit
    return total % 10 == 0


def personal_spans(text):
    text = text or ""
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [
        ("ip", m.start(), m.end())
        for m in IP.finditer(text)
        if all(int(x) <= 255 for x in m[0].split("."))
    ]
    spans += [
        ("card", m.start(), m.end())
        for m in CARD.finditer(text)
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))
    ]
    spans += [
        ("phone", m.start(), m.end())
        for m in PHONE.finditer(text)
        if 8 <= len(digits(m[0])) <= 15
    ]
    return spans


def secret_spans(text):
    text = text or ""
    kinds = ("assign", "access", "hex")
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(kinds[k], start, end) for start, k, end in sorted(spans)]


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans):
    return hashlib.sha256(listed(spans).encode()).hexdigest()


def shingles(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard_components(rows, least=85, words=4):
    """``doc_id -> (set size, smallest linked doc_id)``."""
    sets = {key: shingles(text, words) for key, text in rows}
    where = {}
    for key, held in sets.items():
        for shingle in held:
            where.setdefault(shingle, []).append(key)
    label = {key: key for key in sets}

    def root(key):
        while label[key] != key:
            key = label[key]
        return key

    for key, held in sets.items():
        near = {other for shingle in held for other in where[shingle] if other < key}
        for other in near:
            both = len(held & sets[other])
            if 100 * both >= least * (len(held) + len(sets[other]) - both):
                a, b = sorted((root(key), root(other)))
                label[b] = a
    return {key: (len(held), root(key)) for key, held in sets.items()}


def faults(rows):
    """Fault of each ``(role, text)`` row of one conversation, in order."""
    seen, found = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest_audit(initials, faults):
    """``(cost, audit)`` by search over whole strings: every edit of every row, two inserts at most."""
    best = {"": (0, "")}  # the last two roles' worth of pattern: "", "s", "u", "a"
    follow = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    def with_inserts(held):
        for _ in range(3):
            for state, (cost, audit) in list(held.items()):
                for role in "ua":
                    then = follow[role].get(state)
                    if then:
                        held[then] = min(held.get(then, (10**9, "")), (cost + 3, audit + "I"))
        return held

    best = with_inserts(best)
    for initial, fault in zip(initials, faults, strict=True):
        then = {}

        def offer(state, cost, audit):
            then[state] = min(then.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            offer(state, cost + 4, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if state in follow.get(initial, {}):
                offer(follow[initial][state], cost + more, audit + "K")
            for role in "ua":
                if state in follow[role]:
                    offer(follow[role][state], cost + more + 3, audit + "R")
        best = with_inserts(then)
    return min(best[state] for state in ("", "a") if state in best)


def repaired(rows, audit):
    """Rows an audit leaves; their number tells whether a system row comes first."""
    rows, left = iter(rows), []
    for letter in audit:
        row = None if letter == "I" else next(rows)
        if letter != "D":
            left.append((letter, row))
    odd = len(left) % 2
    out = []
    for k, (letter, row) in enumerate(left):
        due = "system" if odd and not k else ("user", "assistant")[(k - odd) % 2]
        role, text = row if letter == "K" else (due, row[1] if row else "")
        assert role[:1] == due[0]
        out.append(f"{role}:{text}")
    return out


def damage(rows):
    """``(conv_id, turn, role, text)`` rows as the query has them."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if value is None else value for value in (role, text))
        name = ":".join(" " if value is None else str(value) for value in (conv_id, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversation(rows):
    """All columns of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    plain_rows = [(role, text) for _, _, role, text in rows]
    initials = [role[:1] for role, _ in plain_rows]
    found = faults(plain_rows)
    turns = {turn for _, turn, _, _ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest_audit(initials, found)
    digest = hashlib.sha256("\n".join(repaired(plain_rows, audit)).encode()).hexdigest()
    return (gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def runs(words, least=12):
    """``(start, length, period)`` of all runs, by comparing at every distance."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            end = i + period
            if end - start >= max(least, 2 * period):
                found[start, end] = min(period, found.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def disclosing(texts, z, least):
    """``(entity, term) -> share`` of texts without near copies; e-mail addresses and domains only."""
    total, kinds, held = len(texts), {}, {}
    for text in texts:
        masked = EMAIL.sub(" ", text)
        words = set(re.findall(r"[^\W\d_]{4,}", masked))
        mails = {m[0] for m in EMAIL.finditer(text)}
        entities = {f"email:{m}" for m in mails} | {f"email of {m.split('@')[1].lower()}" for m in mails}
        copies = kinds.setdefault(text, [0, entities, words])
        copies[0] += 1
        for word in set(re.findall(r"[^\W\d_]{4,}", text)):
            held[word] = held.get(word, 0) + 1
    n_e, n_et, documents = {}, {}, {}
    for copies, entities, words in kinds.values():
        for e in entities:
            n_e[e] = n_e.get(e, 0) + 1
            for t in words:
                n_et[e, t] = n_et.get((e, t), 0) + 1
                documents[e, t] = documents.get((e, t), 0) + copies
    out = {}
    for (e, t), both in n_et.items():
        trials = held[t] - documents[e, t] + both - 1
        if both < 2 or trials <= 0 or n_e[e] >= total:
            continue
        p = (both - 1) / trials
        low = (p + z * z / (2 * trials) - z * math.sqrt((p * (1 - p) + z * z / (4 * trials)) / trials)) / (1 + z * z / trials)
        share = 1 + math.log(low) / math.log(total / n_e[e])
        if share >= least:
            out[e, t] = share
    return out
