"""The models once more in plain Python loops, as an independent check on small claims."""

import math
from collections import Counter, defaultdict


def char_cosine(a, b):
    x, y = Counter(a), Counter(b)
    dot = sum(x[ch] * y[ch] for ch in x)
    size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return dot / size if size else 0.0


def numeric(a, b):
    try:
        gap = abs(float(a) - float(b))
    except ValueError:
        return 0.0
    return 1.0 if gap == 0 else 1.0 / gap


def by_item(claims):
    items = defaultdict(lambda: defaultdict(set))
    for o, p, v, s in claims:
        items[o, p][v].add(s)
    return items


def vote(claims):
    return {item: min(values, key=lambda v: (-len(values[v]), v)) for item, values in by_item(claims).items()}


def clamp(t):
    return 0.9999 if t >= 1 else 0.0001 if t <= 0 else t


def means(claims, worth):
    total, count = Counter(), Counter()
    for o, p, v, s in claims:
        total[s] += worth[o, p, v]
        count[s] += 1
    return {s: clamp(total[s] / count[s]) for s in count}


def boost(items, score, rho, sim):
    return {
        (o, p, v): score[o, p, v] + rho * sum(score[o, p, w] * sim(w, v) for w in values if w != v)
        for (o, p), values in items.items() for v in values
    }


def pick(items, conf):
    return {
        (o, p): min(values, key=lambda v: (-round(conf[o, p, v], 9), v)) for (o, p), values in items.items()
    }


def truth_finder(claims, rounds, rho=0.5, theta=0.1, sim=char_cosine):
    items = by_item(claims)
    trust = {c[3]: 0.8 for c in claims}
    for _ in range(rounds):
        score = {(o, p, v): sum(-math.log(1 - trust[s]) for s in sources)
                 for (o, p), values in items.items() for v, sources in values.items()}
        conf = {k: 1 / (1 + math.exp(-theta * x)) for k, x in boost(items, score, rho, sim).items()}
        trust = means(claims, conf)
    return trust, pick(items, conf)


def judge(claims, truth, trust, c=0.3, n=100, alpha=0.5):
    said = defaultdict(dict)
    for o, p, v, s in claims:
        said[s][o, p] = v
    dep = defaultdict(dict)
    counts = {}
    for a in said:
        for b in said:
            shared = said[a].keys() & said[b].keys()
            if a == b or not shared:
                continue
            kt = sum(said[a][i] == said[b][i] == truth[i] for i in shared)
            kf = sum(said[a][i] == said[b][i] != truth[i] for i in shared)
            kd = len(shared) - kt - kf
            e = 1 - trust[a]
            z = (math.log((1 - alpha) / alpha) + kt * math.log((1 - e) / (1 - e + c * e))
                 + kf * math.log(e / (c * n + e - c * e)) - kd * math.log(1 - c))
            dep[a][b] = 1 / (1 + math.exp(min(z, 700)))
            counts[a, b] = (kt, kf, kd)
    return dep, counts


def accuracy(claims, algo, rounds, rho=0.5, c=0.3, n=100, order="dependence"):
    items = by_item(claims)
    trust = {cl[3]: 0.8 for cl in claims}
    dep, _ = judge(claims, vote(claims), trust, c, n)
    for _ in range(rounds):
        most = {s: max(dep[s].values(), default=0.0) for s in trust}
        key = (lambda s: s) if order == "name" else (lambda s: (-round(most[s], 9), s))
        score = {}
        for (o, p), values in items.items():
            for v, sources in values.items():
                total, before = 0.0, []
                for s in sorted(sources, key=key):
                    t = 1.0 if algo == "DEPEN" else math.log(n * trust[s] / (1 - trust[s]))
                    for b in before:
                        t *= 1 - c * dep[s][b]
                    before.append(s)
                    total += t
                score[o, p, v] = total
        conf = boost(items, score, rho, char_cosine) if algo == "ACCUSIM" else score
        prob = {}
        for (o, p), values in items.items():
            top = max(conf[o, p, v] for v in values)
            mass = sum(math.exp(conf[o, p, v] - top) for v in values)
            prob.update({(o, p, v): math.exp(conf[o, p, v] - top) / mass for v in values})
        trust = means(claims, prob)
        truth = pick(items, conf)
        dep, _ = judge(claims, truth, trust, c, n)
    return trust, truth


def confusion(claims, truth, found):
    tally = Counter()
    for o, p, v, _ in claims:
        if (o, p) not in truth:
            tally["n_unmatched"] += 1
        else:
            tally[(v == found[o, p], v == truth[o, p])] += 1
    return [tally[True, True], tally[True, False], tally[False, True], tally[False, False], tally["n_unmatched"]]
