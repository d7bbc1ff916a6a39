"""Plain versions of the operators, by definition, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

ASSIGN = re.compile(r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _told(found, kinds):
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*(sum(k == x for x, _, _ in found) for k in kinds), hashlib.sha256(text.encode()).hexdigest(), text)


def secrets(text):
    text, kinds, out = text or "", ["assign", "access", "hex"], []
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return _told(sorted(out, key=lambda s: (s[1], kinds.index(s[0]))), kinds)


def private(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return _told(out, ["email", "ip", "card", "phone"])


def private_terms(rows, disclosure=0.9, chance=0.01, near=16):
    """The spans of the disclosing terms of each row, from all pairs of entities and terms."""
    import regex

    marked, masks = [], []
    for _, text in rows:
        text = text or ""
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in private(text)[-1].split(",") if x))
        chars, parts = list(text), []
        for a, b, k in spans:
            if parts and a < parts[-1][1]:
                parts[-1] = (parts[-1][0], max(b, parts[-1][1]), parts[-1][2] + [f"{k}:{text[a:b]}"])
            else:
                parts.append((a, b, [f"{k}:{text[a:b]}"]))
        for a, b, _ in parts:
            chars[a:b] = "\n" * (b - a)
        terms = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", "".join(chars))]
        tokens = sorted([(a, None, e) for a, _, e in parts] + [(a, t, None) for a, _, t in terms], key=lambda x: x[0])
        masks.append(terms)
        marked.append(tokens)
    docs_of_term, docs_of_entity, close = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, tokens in enumerate(marked):
        for i, (_, t, entities) in enumerate(tokens):
            if t is not None:
                docs_of_term[t].add(d)
            for e in entities or ():
                docs_of_entity[e].add(d)
                for _, other, _ in tokens[max(0, i - near) : i + near + 1]:
                    if other is not None:
                        close[e, other].add(d)
    total, told = len(rows), set()
    for e, de in docs_of_entity.items():
        for t in {t for d in de for _, t, _ in marked[d] if t is not None}:
            for both, least in ((close[e, t], 1), (de & docs_of_term[t], 2)):
                texts = len({rows[d][1] or "" for d in both})
                if texts >= least:
                    pmi = math.log(total * len(both) / (len(docs_of_term[t]) * len(de)))
                    if pmi >= disclosure * math.log(total / len(de)) and texts * (pmi - 1) >= -math.log(chance):
                        told.add(t)
    return [[f"term:{a}:{b}" for a, b, t in terms if t in told] for terms in masks]


def base_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality_values(text):
    """What the rules read, by name of the rule; None where a rule abstains. Words and symbols as base_quality() has them."""
    import regex

    text = text or ""
    n, chars, symbols, dup, covered = base_quality(text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ended = sum(bool(re.search(r"[.!?:;\"')\]…。][\x20\x09-\x0D]*$", x)) for x in lines)
    per = lambda a, b: a / b if b else None
    return {
        "symbols": per(symbols, n), "marks": per(sum(c in "!?=_~^{}\\" for c in text), n), "upper": per(len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), chars),
        "dup_lines": per(dup, len(lines)), "repeats": per(covered, n), "distinct": math.log(len(set(words))) / math.log(n) if n > 1 else None,
        "word_length": abs(chars / n - 6) if n else None, "other_chars": per(len(regex.findall(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]", text)), chars),
        "line_ends": per(ended, len(lines)) if len(lines) > 1 else None,
    }


def label_model(votes, rounds=1000):
    """Expectation-maximisation document by document: prior, and how often each rule is right on good and on bad documents."""
    m = len(votes[0])
    prior, right = 0.8, [[0.995] * m, [0.15] * m]
    for _ in range(rounds):
        posteriors = [label_posterior(v, prior, right) for v in votes]
        new = [list(right[0]), list(right[1])]
        for j in range(m):
            cast = [(p, v[j]) for p, v in zip(posteriors, votes, strict=True) if v[j]]
            on_good, on_bad = sum(p for p, _ in cast), sum(1 - p for p, _ in cast)
            broke_good, broke_bad = sum(p for p, v in cast if v < 0), sum(1 - p for p, v in cast if v < 0)
            if on_good and on_bad:
                if broke_good / on_good > broke_bad / on_bad:
                    broke_good = broke_bad = (broke_good + broke_bad) / (on_good + on_bad)
                    on_good = on_bad = 1
            new[0][j] = 1 - broke_good / on_good if on_good else new[0][j]
            new[1][j] = broke_bad / on_bad if on_bad else new[1][j]
            new[0][j], new[1][j] = min(0.9995, max(0.5, new[0][j])), min(0.98, max(0.02, new[1][j]))
        before, (prior, right) = (prior, right), (min(0.999, max(0.05, sum(posteriors) / len(votes))), new)
        if abs(before[0] - prior) + sum(abs(x - y) for a, b in zip(before[1], right, strict=True) for x, y in zip(a, b, strict=True)) < 1e-9:
            break
    return prior, right


def label_posterior(votes, prior, right):
    good, bad = prior, 1 - prior
    for j, v in enumerate(votes):
        if v:
            good *= right[0][j] if v > 0 else 1 - right[0][j]
            bad *= right[1][j] if v < 0 else 1 - right[1][j]
    return good / (good + bad)


def substring_dedup(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    own = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                own[tuple(w[i : i + window])] = min(own.get(tuple(w[i : i + window]), d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - window + 1) if d is not None and own[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bag(text, size=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    common = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - common
    return common / every if every else 0.0


def near_classes(rows, threshold=0.8):
    bags, inverse = {d: bag(t) for d, t in rows}, defaultdict(set)
    for d, b in bags.items():
        for s in b:
            inverse[s].add(d)
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, b in bags.items():
        for o in set().union(*(inverse[s] for s in b)) if b else ():
            if o < d and jaccard(b, bags[o]) >= threshold:
                x, y = sorted((find(d), find(o)))
                parent[y] = x
    return {d: find(d) for d in bags}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def budgets(supply, mixture):
    """The tokens of each leaf: shares by weight from the root down; children that can't use theirs are filled and leave the rest to the others."""
    leaves = {k: v * mixture.max_epochs for k, v in sorted(supply.items())}

    def weight(path):
        options = [path, ("*", *path[1:]), ("*", "*", *path[2:])]
        return next((mixture.weights[p[: len(path)]] for p in options if p[: len(path)] in mixture.weights), mixture.default)

    def below(node):
        return sum(v for k, v in leaves.items() if k[: len(node)] == node)

    def fill(node, given, out):
        if len(node) == 3:
            out[node] = int(given + 1e-6)
            return
        open_, left, shares = sorted({k[: len(node) + 1] for k in leaves if k[: len(node)] == node}), given, {}
        while open_:
            weights = {c: max(0.0, weight(c)) for c in open_}
            if not sum(weights.values()):
                weights = dict.fromkeys(open_, 1.0)
            full = [c for c in open_ if left * weights[c] / sum(weights.values()) >= below(c)]
            if not full:
                shares |= {c: left * weights[c] / sum(weights.values()) for c in open_}
                break
            shares |= {c: below(c) for c in full}
            left -= sum(below(c) for c in full)
            open_ = [c for c in open_ if c not in full]
        for c, x in shares.items():
            fill(c, x, out)

    out = {}
    fill((), min(mixture.ratio * sum(supply.values()), below(())), out)
    return out


def trigrams(text, bits=13):
    """Slots of the byte trigrams of a text, in which all but letters are spaces."""
    b = [c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in f" {text.lower()} ".encode()]
    out = Counter()
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        if (x, y) != (32, 32) and (y, z) != (32, 32):
            out[((x * 65599 + y) * 65599 + z) * 2654435769 % 2**32 >> (32 - bits)] += 1
    return out


def language_shares(text, model, penalty=2.0, rounds=12):
    """The proportions of the languages chosen for one text, and the score."""
    langs, cells = list(model), trigrams(text)
    if not cells:
        return {}, 0.0
    logs = {j: {s: float(model[x][s]) for s in cells} for j, x in enumerate(langs)}
    size = sum(cells.values())

    def run(pick, pi, n):
        for _ in range(n):
            new = dict.fromkeys(pick, 0.0)
            for s, c in cells.items():
                top = max(logs[j][s] for j in range(len(langs)))
                joint = {j: pi[j] * math.exp(logs[j][s] - top) for j in pick}
                for j in pick:
                    new[j] += c * joint[j] / sum(joint.values())
            new = {j: max(x / size, 1e-6) for j, x in new.items()}
            pi = {j: x / sum(new.values()) for j, x in new.items()}
        loss = sum(c * math.log(sum(pi[j] * math.exp(logs[j][s] - max(logs[k][s] for k in range(len(langs)))) for j in pick) + 1e-300) for s, c in cells.items())
        return pi, loss

    everything = list(range(len(langs)))
    pi, _ = run(everything, dict.fromkeys(everything, 1 / len(langs)), rounds)
    order = sorted(everything, key=lambda j: -pi[j])
    best, chosen = -math.inf, {}
    for k in range(1, len(langs) + 1):
        pick = order[:k]
        start = {j: pi[j] / sum(pi[i] for i in pick) for j in pick}
        p, loss = run(pick, start, 0 if k == 1 else rounds)
        value = loss / 3 - penalty * k * math.log(max(size / 3, 2.0))
        if value <= best:
            break
        best, chosen = value, p
    single = [sum(c * logs[j][s] for s, c in cells.items()) / 3 for j in everything]
    certainty = 1 / sum(math.exp(x - max(single)) for x in single)
    return {langs[j]: x for j, x in chosen.items()}, max(chosen.values()) * certainty
