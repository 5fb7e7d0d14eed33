"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import batches, lower_ascii, mix64

#: (action, domain, path prefix). A rule fits its domain and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS = 14
ORDERS = (3, 4, 5)


# The words of the labelled table. Modifiers stand before or after the words of their side; shared ones on both.
BLOCKED = "ads advert banner popup tracker clickbait casino poker betting jackpot slots lottery pills viagra porn xxx sexcam escort warez keygen malware phishing spam adserver".split()
ALLOWED = "blog news wiki docs library school science weather music recipes garden travel history museum city health sports books forum photo radio theatre bank railway".split()
LURES = "free cheap hot win bonus vip sexy instant cash deals nolimit unlocked promo track click spins".split()
PLAIN = "daily open local public my the our national modern green little old community family guide notes".split()
SHARED = "online best world 24 top web".split()


def pseudo_words(n: int) -> list[str]:
    """Invented names of two to four syllables, spelt by rule from all simple and common double onsets, vowels and codas."""
    onsets = [*"bcdfghjklmnprstvwz", "bl", "br", "ch", "cl", "cr", "dr", "fl", "gr", "pl", "pr", "sh", "sl", "st", "th", "tr"]
    codas = ["", "", "", "l", "m", "n", "r", "s", "t", "nd", "ng", "nt", "rd", "st"]
    out, x = [], 12345
    for i in range(n):
        word = ""
        for _ in range(2 + i % 3):
            x = (1103515245 * x + 12345) % 2**31
            word += onsets[(x >> 8) % len(onsets)] + "aeiou"[(x >> 16) % 5] + codas[(x >> 20) % len(codas)]
        out.append(word)
    return out


def labelled_urls(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, names: int = 200) -> list[tuple[str, int]]:
    """A small labelled URL table, spelt out by rule: (url, 1 for block or 0 for allow).

    Blocked are hosts and paths of trackers, gambling, adult pages and malware; allowed are ordinary sites and invented names.
    A word stands alone, with a modifier of its side or a shared one, with another word of its side, in the plural, or
    (blocked ones) with digits for letters. Numbers, languages, suffixes and subdomains are the same on both sides, so
    that none of these tells the labels apart.
    """
    urls = []
    for words, modifiers, label in ((blocked, LURES, 1), ([*allowed, *pseudo_words(names)], PLAIN, 0)):
        for i, word in enumerate(words):
            other, at = words[(i * 5 + 3) % len(words)], lambda k, m=modifiers, i=i: m[(3 * i + 5 * k) % len(m)]
            shared = SHARED[i % len(SHARED)]
            forms = [word, f"{word}s", f"{at(0)}-{word}", f"{at(1)}{word}", f"{word}-{at(2)}", f"{word}{at(3)}", f"{shared}{word}", f"{word}-{shared}", f"{word}-{other}", f"{at(4)}-{word}-{at(5)}"]
            if label:
                forms += [word.translate(str.maketrans("oie", "013")), f"{at(6)}-{at(7)}"]
            for j, form in enumerate(forms):
                n = 12 * i + j
                sub, tld = (("", "com"), ("www.", "org"), ("m.", "net"), ("blog.", "org"))[n % 4]
                lang = ("en", "fr", "de", "es")[n // 4 % 4]
                tail = ("", "/", ".html", "?page=2&ref=x")[n // 16 % 4]
                urls.append((f"https://{sub}{form}.site{n % 7}.{tld}/{lang}/{1000 + 37 * n}{tail}", label))
                urls.append((f"http://{sub}{form}.example.{tld}/{lang}/{40 + 91 * n}{tail}", label))
                urls.append((f"https://{sub}page{n % 5}.{tld}/{form}/{lang}/{n}{tail}", label))
    return urls


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, action) of the longest fitting rule, the earlier one of two equally long; else nulls.

    The rules are a short list in the plan, not a table: no join.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = action = None
    for act, domain, prefix in ordered:
        fits = ((host_col == domain) | host_col.endswith(f".{domain}")) & path_col.startswith(prefix)
        rule = F.when(fits, domain + prefix) if rule is None else rule.when(fits, domain + prefix)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, action)


def features(hosts: list[str], paths: list[str], bits: int = BITS, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram; host and path are told apart by a mark before and after each."""
    rows, buckets = [], []
    for mark, texts in ((b"\x01", hosts), (b"\x02", paths)):
        raw = [mark + t.encode() + mark for t in texts]
        length = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), length)
        salt = np.uint64(mark[0])
        for n in orders:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, salt, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            rows.append(owner[: len(h)][inside])
            buckets.append((mix64(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def split_url(url: str | None) -> tuple[str, str]:
    """The host and path of one URL, as the Column functions give them."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), tail[:end]


def train(labelled: list[tuple[str, int]], rounds: int = 150, rate: float = 8.0, momentum: float = 0.9, decay: float = 1e-5, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights (2**bits of them) and bias by full-batch gradient descent with momentum; no randomness, so reruns agree.

    Allowed rows weigh more than twice what blocked ones do in sum, whatever their numbers: a name like no other is allowed. The table is a parameter of a few thousand rows at
    most; it stays on the driver.
    """
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    y = np.array([v for _, v in labelled], float)
    share = np.where(y == 1, 0.3 / max(1, y.sum()), 0.7 / max(1, (1 - y).sum()))
    row, bucket = features(list(hosts), list(paths), bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, b, step, step_b = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[bucket], len(y)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        step = momentum * step - rate * (np.bincount(bucket, (g * scale)[row], 1 << bits) + decay * w)
        step_b = momentum * step_b - rate * g.sum()
        w, b = w + step, b + step_b
    return w, b


def score(hosts: list[str], paths: list[str], w: np.ndarray, b: float, bits: int = BITS) -> np.ndarray:
    row, bucket = features(hosts, paths, bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
    return 1 / (1 + np.exp(-(np.bincount(row, w[bucket], len(hosts)) * scale + b)))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages``.

    Only id and url are read, nothing is shuffled, and the model (2**14 weights) travels in the task. A null url, or one
    without ``://``, has an empty host and path, fits no rule and is judged on these empty strings. Repeated rows and
    null ids are kept as they are. score is the method's probability of "block" for every url, ruled or not.
    """
    w, b = train(labelled or labelled_urls())
    weights = w.astype(np.float32)

    def run(ids, hosts, paths, rule, action):
        p = score(hosts, paths, weights, b)
        verdict = [a or ("block" if s >= threshold else "allow") for a, s in zip(action, p.tolist(), strict=True)]
        return {"page_id": ids, "host": hosts, "path": paths, "rule": rule, "verdict": verdict, "score": p.tolist()}

    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(F.col(f"`{url_col}`")).alias("host"), path(F.col(f"`{url_col}`")).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    schema = "page_id bigint, host string, path string, rule string, verdict string, score double"
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    return ruled.mapInArrow(batches(run, schema, struct, "page_id", "host", "path", "rule", "action", size=1 << 20), struct)
