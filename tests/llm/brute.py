"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
KINDS = ["assign", "access", "hex", "user", "key", "endpoint"]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingle_set(text, width):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def statistics(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def secret_parts(text):
    """[(start, kind rank, stop, strong, role)], all candidates."""
    text = text or ""
    out = []
    assign = re.compile(
        "((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])"
        "|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    for m in assign.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), True, "secret"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), True, "identifier"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), True, "secret"))
    for m in re.finditer("(username|user|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", text):
        if len(m[2]) >= 3:
            out.append((m.start(), 3, m.end(), False, "identifier"))
    for m in re.finditer("[A-Za-z0-9+/]{32,}", text):
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]):
            out.append((m.start(), 4, m.end(), False, "secret"))
    endpoint = (
        "(?:https?|ftp|postgres|mysql|mongodb|redis)://[A-Za-z0-9._~:@-]+"
        "|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}:[0-9]{2,5}"
    )
    for m in re.finditer(endpoint, text):
        if len(m[0]) >= 8:
            out.append((m.start(), 5, m.end(), False, "endpoint"))
    return sorted(out)


def secrets(text, reach=200):
    found = secret_parts(text)
    strong = [p for p in found if p[3]]
    shown = [p for p in found if p[3] or any(q[4] != p[4] and abs(q[0] - p[0]) <= reach for q in found)]
    join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)
    counts = [sum(p[1] == k for p in strong) for k in range(3)]
    return (*counts, hashlib.sha256(join(strong).encode()).hexdigest(), join(shown))
