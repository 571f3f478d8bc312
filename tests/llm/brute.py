"""Plain versions of what the queries return, for small tables."""

import collections
import re


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def shingles(text, n=3, word=r"[^\x20\x09-\x0D]+"):
    w = re.findall(word, lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, percent=90):
    """(id, set size, least id of the component) for (id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def contained(docs, items, percent=80):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for i, t in docs:
        s = shingles((t or "").lower(), 5, word)
        for j, u in items:
            v = shingles((u or "").lower(), 5, word)
            if v and 100 * len(s & v) >= percent * len(v):
                out.append((i, j, len(s & v), len(v)))
    return sorted(out)


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def personal(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(out))


VOWELS, CONSONANTS = "aeiou", "bcdfglmnprstv"


def prose(rng, n):
    word = lambda: "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(n)]
    for i in range(0, n, 9):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += rng.choice([".", ".", "!", ".\n"])
    return " ".join(words)


def chains(words, templates, min_match=4, max_gap=8, min_words=8, min_cover=0.5):
    """(label, first word, word after the last) of the chains of long matches, by search in each template."""
    found = []
    for label, t in templates:
        ends = collections.defaultdict(list)
        for i in range(len(t)):
            for k in range(min_match, i + 2):
                ends[tuple(t[i + 1 - k : i + 1])].append(i)
        longest = [max((k for k in range(min_match, min(i + 1, len(t)) + 1) if tuple(words[i + 1 - k : i + 1]) in ends), default=0) for i in range(len(words))]
        now = None
        for i, k in enumerate(longest):
            if not k or i + 1 < len(words) and longest[i + 1] == k + 1:
                continue
            places = ends[tuple(words[i + 1 - k : i + 1])]
            later = [e for e in places if now and e >= now[3]]
            if later and i + 1 - k - now[1] <= max_gap:
                now = [now[0], i + 1, now[2] + max(0, min(k, i + 1 - now[1], later[0] - now[3])), later[0]]
            else:
                found += [(label, len(t), *now)] if now else []
                now = [i + 1 - k, i + 1, k, places[0]]
        found += [(label, len(t), *now)] if now else []
    kept = []
    for label, size, first, stop, n, _ in sorted(found, key=lambda c: -c[4]):
        if (n >= min_words or n >= min_cover * size) and not any(m > n and a < stop and first < b for _, a, b, m in kept):
            kept.append((label, first, stop, n))
    return sorted(c[:3] for c in kept)


PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def statistics(text):
    """The quality classifier's features of one text."""
    import math

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(len(w), 1), max(len(text), 1)
    size = [len(x) for x in w]
    mean = sum(size) / n
    count = lambda cs: sum(text.count(c) for c in cs)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    letters = [len(re.findall("[A-Za-z]", x)) + sum(b >= 128 for b in x.encode()) for x in w]
    caps = [len(re.findall("[A-Z]", x)) for x in w]
    return [
        math.log1p(len(text)), math.log1p(len(w)), min(mean, 50), math.sqrt(max(0, sum(min(s, 200) ** 2 for s in size) / n - min(mean, 200) ** 2)),
        len(re.findall("[A-Z]", text)) / chars, len(re.findall("[0-9]", text)) / chars, count(PUNCT) / chars,
        count("#*$%&|<>") / n, count("!") / n, sum(b >= 128 for b in text.encode()) / chars, count("\n") / n, count(".") / n, count(",") / n, count("|") / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(hit) / n, len(set(w)) / n, len({(a, b) for a, b in zip(w, w[1:])}) / n,  # noqa: B905, RUF007
        sum(c == k and k > 1 for c, k in zip(caps, letters, strict=True)) / n, sum(bool(re.search("[0-9]", x)) for x in w) / n,
        sum(x[-1] in PUNCT for x in w) / n, sum(k == 0 for k in letters) / n,
    ]


def toxic_features(text, lexicons, second, leet, learnt):
    """The toxicity features of one text; learnt: stem -> log odds."""
    import math

    text = text or ""
    low = lower(text)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    spans = [m.span() for m in re.finditer(pattern, low)]
    w = [low[a:b] for a, b in spans]
    kinds = {}
    for k, line in enumerate([*lexicons, second]):
        for x in line.split():
            kinds.setdefault(x, k)
    kind = [kinds.get(x, -1) for x in w]
    n, bad = max(len(w), 1), [0 <= k < len(lexicons) for k in kind]
    out = []
    add = lambda k: out.extend([min(1, k / n), math.log1p(k)])
    for k in range(len(lexicons)):
        add(kind.count(k))
    add(sum(bad))
    add(sum(b and len(lexicons) in kind[max(0, i - 5) : i + 6] for i, b in enumerate(bad)))
    out.append(kind.count(len(lexicons)) / n)
    plain = "".join(leet.get(c, c) for c in low)
    odd = [(a, b) for a, b in (m.span() for m in re.finditer(pattern, plain)) if any(c in leet for c in low[a:b]) and re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", "".join(c for c in low[a:b] if c not in leet))]
    add(sum(0 <= kinds.get(plain[a:b], -1) < len(lexicons) for a, b in odd))
    out.append(math.log1p(sum(b and re.fullmatch("[A-Z]+", text[x:y]) is not None for b, (x, y) in zip(bad, spans, strict=True))))
    out += [len(re.findall("[A-Z]", text)) / max(len(text.encode()), 1), text.count("!") / n, text.count("?") / n]
    out.append(sum(low[b - 1] not in leet for _, b in odd) / n)
    weight = [max([learnt.get(x.encode()[:k], 0) for k in (4, 5, 6) if len(x.encode()) >= k], default=0) for x in w]
    own = [x for x, v in zip(w, weight, strict=True) if v]
    add(len(own))
    return [*out, math.log1p(sum(weight)), max(weight, default=0), math.log1p(len(set(own)))]


BLOCKS = {"html", "body", "div", "p", "ul", "li", "nav", "footer", "article", "h1", "section"}


def render(node):
    if isinstance(node, str):
        return node
    name, cls, children = node
    return f"<{name}{f' class={cls!r}' if cls else ''}>" + "".join(map(render, children)) + f"</{name}>"


def site(pages, min_pages=4):
    """The main texts of the well-formed pages of one host, and how many blocks its templates took; a page is a body."""

    def holds(node):
        return not isinstance(node, str) and (node[0] in ("article", "h1") or any(map(holds, node[2])))

    def size(node, link=False, only=False):
        if isinstance(node, str):
            return len(node.strip()) if link or not only else 0
        return sum(size(c, link or node[0] == "a", only) for c in node[2])

    def form(node):
        out = []

        def walk(children):
            for c in children:
                new = [("text" if c.strip() else None)] if isinstance(c, str) else [form(c)] if c[0] in BLOCKS else ["a"] if c[0] == "a" else []
                for x in new:
                    if x and out[-1:] != [x] and not (x == "a" and out[-2:] == ["a", "text"]):
                        out.append(x)
                if not isinstance(c, str) and c[0] not in BLOCKS:
                    walk(c[2])

        walk(node[2])
        return ("form", node[0], node[1], tuple(out))

    def kinds(node, has_article, inside=False):
        """The signatures of one subtree that count."""
        if node[0] in ("html", "body") or not size(node) or inside and node[0] in ("p", "h1", "li", "article"):
            return []
        out = [repr(node)]
        links = 2 * size(node, only=True) >= size(node)
        if not holds(node) and (links and node[0] in ("div", "section") and node[1] if inside else has_article or links):
            out.append(form(node))
        return out

    def walk(node, visit, inside=False):
        if not isinstance(node, str) and node[0] in BLOCKS:
            visit(node, inside)
        if not isinstance(node, str):
            for c in node[2]:
                walk(c, visit, inside or node[0] == "article")

    def blocks(body, deleted, has_article):
        out, run = [], []

        def flush(state):
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append((text, *state))

        def go(node, state):
            if isinstance(node, str):
                run.append(node)
                return
            here = state
            if node[0] in BLOCKS:
                flush(state)
                gone = any(k in deleted for k in kinds(node, has_article, state[0]))
                here = (state[0] or node[0] == "article", state[1] or node[0] in ("nav", "footer"), state[2] or gone)
            for c in node[2]:
                go(c, here)
            if node[0] in BLOCKS:
                flush(here)

        go(body, (False, False, False))
        return out

    def text(found):
        left = [b for b in found if not (b[2] or b[3])]
        return "\n".join(b[0] for b in ([b for b in left if b[1]] or left))

    counts = collections.defaultdict(set)
    articles = [any(b[1] for b in blocks(p, (), False)) for p in pages]
    for p, has in zip(pages, articles, strict=True):
        body = text(blocks(p, (), has))
        walk(p, lambda node, inside, body=body, has=has: [counts[k].add(body) for k in kinds(node, has, inside)])
    deleted = {k for k, bodies in counts.items() if len(bodies) >= min_pages}
    found = [blocks(p, deleted, has) for p, has in zip(pages, articles, strict=True)]
    return [(text(f), sum(b[3] for b in f)) for f in found]
