"""Which files were written by hand: belief propagation over directory trees.

Every file gives evidence from its own text and name; every directory from its name. The
labels of a directory and of what it holds tend to agree, so beliefs pass up the tree of
a repository and down again (exact on a tree, two sweeps). A file that matches a file of
another repository passes on what is known of that one: copies share a class.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.shared import materialise

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEND, BLOB = range(5)
#: Labels of directories before their names and contents are seen.
PRIOR = (0.96, 0.01, 0.01, 0.01, 0.01)
#: Row: label of a directory; column: label of a file or directory in it. A directory of hand-written
#: work often holds other things as well; one of other work holds little else.
GIVEN = (
    (0.74, 0.09, 0.05, 0.07, 0.05),
    (0.12, 0.84, 0.01, 0.02, 0.01),
    (0.20, 0.06, 0.70, 0.02, 0.02),
    (0.01, 0.01, 0.01, 0.96, 0.01),
    (0.20, 0.03, 0.01, 0.01, 0.75),
)
#: What an unremarkable file says against each other label.
PLAIN = 2.5
#: How far the text alone may go; strong signs stay finite so that neighbours can add up.
STRONG = 6.0
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold shares a bucket with probability 0.9999, one at 0.4 with 0.12.
BANDS, ROWS = 32, 6

# How tools and importers announce themselves: a comment of its own that opens with the announcement, or an order not to edit
# that ends its sentence. What stands in quotes is spoken of, and is taken out before.
_SUBJECT = r"(?:(?:this|the following) )?(?:(?:file|code|source|module|header|class|output|document)s? )?(?:(?:is|was|are|were|has been|have been) )?"
_GENERATED = re.compile(
    rf"(?i)^(?:@generated\b|</?auto-?generated\b|{_SUBJECT}(?:auto)?(?:generated|transpiled) (?:automatically )?(?:by|from|with|at|on|using|via)\b"
    rf"|{_SUBJECT}(?:automatically|machine|auto)[ -](?:generated|written|created|produced|built)\b|(?:dies\w* \w+ )?(?:wurde |wird |ist )?automatisch (?:erzeugt|generiert|erstellt)\b)"
    r"|(?:^|[.!;:,*\u2013\u2014-]\s*)(?:please )?(?:do not|don't|never) (?:edit|modify|change)(?: (?:this(?: file)?|it|by hand|manually|directly|below(?: this line)?))*\s*(?:$|[.!;:,*()/\u2013\u2014-])"
    r"|\b(?:changes|edits|modifications)(?: made)?(?: to this file| here| by hand)? (?:will|may|would) be (?:lost|overwritten|discarded)\b"
    r"|(?:^|[.;:\u2013\u2014-]\s*)(?:to )?re-?generate (?:with|using|by|via)\b"
)
_IMPORTED = re.compile(
    r"(?i)^(?:this (?:file )?is )?an? (?:[\w\-]+ )?copy of \S+ (?:out of|from|as in) (?:the )?([\w.\-]+)|^(?:file )?imported from ([\w.\-]+)@\d|^(?:vendored|copied|taken|adapted|ported|borrowed) from ([\w.\-/]+)"
    r"|^!?\s*([a-z][\w.\-]*),? (?:version )?v?\d+\.\d+(?:\.\d+)?\b.*(?:\(c\)|copyright|licen[cs]e)|^package(?:-?name)?:\s*([\w.\-]+)\s*$"
)
_UPSTREAM = re.compile(r"(?i)^(?:upstream|vendored|imported)-?(?:version|commit|revision|url|release)\s*:")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'(?!\w)|`[^`]*`")
_LEAD = re.compile(r"^[\s#/*;!\-<'\"]*(?=[<@A-Za-z])")
#: A line without any of these (in lower case) announces nothing; every form above holds one (a test compares both ways).
_SIGNS = "generat transpiled automati machine auto- edit modif change copy imported vendored copied taken adapted ported borrowed (c) licen package upstream".split()
_VENDOR_DIRS = frozenset("node_modules bower_components third_party third-party thirdparty pods site-packages dist-packages external externals deps vendor vendored jspm_packages".split())
_GENERATED_DIRS = frozenset("gen generated __generated__ autogen".split())
_BUILD_DIRS = frozenset("dist build out target public assets static".split())
_LOCKS = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml go.sum cargo.lock poetry.lock pipfile.lock composer.lock gemfile.lock".split())
_GENERATED_NAME = re.compile(r"(?i)(?:\.pb(?:\.\w+)?|\.g|\.generated|_generated|_gen|_pb2(?:_grpc)?|\.designer)\.\w+$|_pb2\.pyi?$")
_CLIENT_NAME = re.compile(r"(?i)_client\.\w+$")
_MINIFIED_NAME = re.compile(r"(?i)[.\-]min\.(?:js|css)$|\b(?:chunk|main|bundle|vendor)[.\-][0-9a-f]+\.(?:js|css)$")
_CODE = re.compile(r"(?i)\.(?:js|mjs|cjs|ts|css|py|go|java|c|h|cc|cpp|rb|php|cs|rs|kt|swift|scala)$")
_COMMENT_STARTS = ("#", "//", "/*", "*", "--", ";", "<!--", "'''", '"""')
_BLOCK_ENDS = {"/*": "*/", "<!--": "-->"}
_DIGITS = re.compile(r"\d+")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/=]{60}|(?:\\x[0-9a-fA-F]{2}){8}")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_DATUM = re.compile(r"0x[0-9a-fA-F]+|(?:\\x[0-9a-fA-F]{2})+|-?\d+(?:\.\d+)?|(?<=[\"'`])[A-Za-z0-9+/=]{40,}(?=[\"'`])")


def repository(uri: str | None, metadata_repo: str | None) -> str:
    """The repository an artifact belongs to; files of none get their host's name."""
    if metadata_repo:
        return metadata_repo.lower()
    u = uri or ""
    m = re.match(r"(?i)https?://[^/]+/([^/]+/[^/]+)/(?:-/)?(?:blob|raw|tree|src)/", u) or re.match(r"(?i)file:///srv/checkouts/([^/]+/[^/]+)/", u)
    if m:
        return m[1].lower()
    m = re.match(r"(?i)[a-z]+://([^/]+)", u)
    return m[1].lower() if m else ""


def location(path: str | None, uri: str | None) -> str:
    """The path in the repository; for files of the web, that of the address."""
    p = (path or "").strip().replace("\\", "/")
    if not p:
        p = re.sub(r"[?#].*$", "", re.sub(r"(?i)^[a-z]+://[^/]*", "", uri or ""))
    return "/".join(x for x in p.split("/") if x not in ("", "."))


def _comment_lines(lines: list[str]) -> list[bool]:
    """Which lines are comments, those inside a block comment too."""
    out, end = [], ""
    for x in lines:
        if end:
            out.append(True)
            if end in x:
                end = ""
            continue
        y = x.lstrip()
        out.append(y.startswith(_COMMENT_STARTS))
        if y.startswith(("/*", "<!--")):
            mark = "<!--" if y[0] == "<" else "/*"
            if _BLOCK_ENDS[mark] not in y[len(mark) :]:
                end = _BLOCK_ENDS[mark]
    return out


def announcement(line: str) -> tuple[str, re.Match | None]:
    """What a comment line says its file is: ``generated``, ``imported``, ``upstream`` or nothing."""
    said = line.strip()
    if said.startswith("<!--"):
        said = said[4:]
    said = _LEAD.sub(lambda m: "<" if m[0].endswith("<") else "", said)
    said = _QUOTED.sub("", said).strip()
    if _UPSTREAM.search(said):
        return "upstream", None
    if _GENERATED.search(said):
        return "generated", None
    m = _IMPORTED.search(said)
    return ("imported", m) if m else ("", None)


def evidence(text: str | None, where: str, repo: str) -> tuple[list[float], str]:
    """Log-odds of each label against handwritten from a file's text and name, and the library it says it is from.

    Every comment line is read. Where an announcement stands sets its weight: in full before the code or among the last
    lines, half of it in between, where it may be of a part only.
    """
    odds = [0.0] * 5
    text = text or ""
    body = text.lstrip("\ufeff")
    name = where.rsplit("/", 1)[-1].lower()
    if not body.strip():
        return [0.0, *[-STRONG] * 4], ""
    full = [x for x in body.replace("\r", "").split("\n") if x and not x.isspace()]
    size = sum(map(len, full))
    library = inner = ""
    generated, imported = 0.0, 0.0
    low = body.lower()
    if any(w in low for w in _SIGNS):
        comments = _comment_lines(full)
        opening = next((i for i, c in enumerate(comments) if not c), len(full))  # a comment block before any code, however long
        seen_code = 0
        for i, x in enumerate(full):
            seen_code += not comments[i]
            if not (comments[i] or seen_code <= 2):
                continue
            low = x.lower()
            if not any(w in low for w in _SIGNS):
                continue
            kind, m = announcement(x)
            if not kind or not (comments[i] or kind == "upstream"):
                continue
            sure = i < opening or seen_code <= 2 or i >= len(full) - 3  # some tools sign at the end
            if kind == "generated":
                generated = max(generated, STRONG if sure else STRONG / 2)
            elif kind == "upstream":
                imported = max(imported, STRONG if sure else STRONG / 2)
            elif sure:
                library, imported = next(g for g in m.groups() if g).lower(), STRONG
            else:
                # inside a file, a phrase such as "taken from" tells of a few lines rather than of the file
                imported = max(imported, STRONG / 4 if m[3] and "endored" not in x else STRONG / 2)
                inner = inner or ("" if m[3] else next(g for g in m.groups() if g).lower())
    odds[GEN] += generated
    library = library or inner
    if imported:
        own = library and library in repo.split("/")
        odds[VEND] += -imported if own else imported
    # tools' own file kinds
    if name in _LOCKS or '"lockfileVersion"' in body and re.search(r'"lockfileVersion"\s*:\s*\d', body):
        odds[GEN] += STRONG
    elif " h1:" in body and sum(bool(re.search(r" h1:[A-Za-z0-9+/]{40,}=", x)) for x in full) * 2 > len(full):
        odds[GEN] += STRONG
    if name.endswith(".map") and '"mappings"' in body or re.match(r'\s*\{"version":3,', body):
        odds[GEN] += STRONG
    if ("#line" in body or "yy" in body) and sum(bool(re.match(r"\s*#line \d+ \"|.*\byyvsp\b|.*\byyparse\b", x)) for x in full) >= max(3, len(full) * 0.2):
        odds[GEN] += STRONG
    if _GENERATED_NAME.search(name):
        odds[GEN] += 3.5
    elif _CLIENT_NAME.search(name):
        odds[GEN] += 1.0
    code = bool(_CODE.search(name))
    digits = sum(map(body.count, "0123456789"))
    # the same lines over and over, with running numbers
    if code and digits * 100 > size:
        long = [x.strip() for x in full if len(x.strip()) >= 14 and not x.lstrip().startswith(_COMMENT_STARTS)]
        if len(long) >= 6:
            shapes: dict[str, int] = {}
            for x in long:
                shape = _DIGITS.sub("0", x)
                shapes[shape] = shapes.get(shape, 0) + 1
            rolled = sum(n for n in shapes.values() if n >= 3)
            if rolled >= 0.6 * len(long):
                odds[GEN] += 5.0
    # data
    dense = 0.0
    if code and (digits * 12 > size or _LONG_RUN.search(body)):
        data = sum(len(m[0]) for m in _DATUM.finditer(body))
        dense = data / max(1, sum(len(x.strip()) for x in full))
        if data >= 600 and dense > 0.5:
            odds[BLOB] += STRONG
        elif data >= 400 and dense > 0.4:
            odds[BLOB] += 3.0
    # compressed scripts and styles
    if re.search(r"(?i)\.(?:js|mjs|cjs|css|ts)$", name) or _MINIFIED_NAME.search(name):
        blank = (body.count(" ") + body.count("\t")) / max(1, len(body))
        if size > 200 and blank < 0.09 and dense < 0.5:
            words = _IDENT.findall(body)
            short = sum(len(w) <= 2 for w in words) / max(1, len(words))
            mean = size / max(1, len(full))
            style = name.endswith(".css")
            if mean > 120 or (short > 0.35 and not style) or (style and mean > 80):
                odds[MIN] += STRONG
            elif short > 0.28:
                odds[MIN] += 3.0
        if _MINIFIED_NAME.search(name):
            odds[MIN] += 2.0
    if max(odds[1:]) <= 0:
        odds[1:] = [x - PLAIN for x in odds[1:]]  # an ordinary look is a sign by itself
    return odds, library


def directory_evidence(name: str) -> list[float]:
    """Log-odds that a directory's name alone gives."""
    odds = [0.0] * 5
    n = name.lower()
    if n in _VENDOR_DIRS:
        odds[VEND] = 9.0
    elif n in _GENERATED_DIRS:
        odds[GEN] = 2.0
    elif n in _BUILD_DIRS:
        odds[MIN] = 0.7
    return odds


# --- copies in other repositories


_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE_WORDS)]


def _shingles(text: str | None, known: dict | None = None) -> np.ndarray:
    """Sorted 63-bit hashes of the different five-word shingles of a text without its comments; texts of a few words keep those."""
    import xxhash

    known = {} if known is None else known
    text = (text or "").lower()
    # comments are what importers and translators change first
    words = _WORD.findall("\n".join([x for x in text.split("\n") if not x.lstrip().startswith(_COMMENT_STARTS)]))
    if len(words) < 8 + SHINGLE_WORDS:
        words = _WORD.findall(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    whole = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE_WORDS, len(h))):
        whole += h[k : k + n] * np.uint64(_STEPS[k])
    whole ^= whole >> np.uint64(31)
    whole *= _MIX
    whole ^= whole >> np.uint64(29)
    return np.unique(whole >> np.uint64(1)).astype(np.int64)


def _signed(texts: pd.Series) -> pd.DataFrame:
    """``set_key`` (equal for equal shingle sets), ``n`` and the keys of the MinHash buckets of each text; texts without a word have none."""
    import xxhash

    seeds = np.random.RandomState(20240229)
    mult = seeds.randint(0, 2**31, size=BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    plus = seeds.randint(0, 2**32, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
    known: dict = {}
    out = []
    for t in texts:
        s = _shingles(t, known)
        if not len(s):
            out.append((xxhash.xxh3_128_digest(t or ""), 0, np.zeros(0, dtype=np.int64)))
            continue
        low = (s.astype(np.uint64) >> np.uint64(31)).astype(np.uint32)
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(low), 4096):
            part = low[i : i + 4096, None] * mult
            part += plus
            least = np.minimum(least, part.min(axis=0))
        rows = least.reshape(BANDS, ROWS).astype(np.uint64)
        mixed = np.arange(BANDS, dtype=np.uint64)
        for c in range(ROWS):
            mixed = (mixed ^ rows[:, c]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), mixed.astype(np.int64)))
    return pd.DataFrame(out, columns=["set_key", "n", "bands"])


_SIGNED = "struct<set_key:binary,n:int,bands:array<long>>"
#: Places that the rows of a hot key are spread over, where a table is large enough for one key to burden a task.
SALTS, SALT_ROWS = 64, 1_000_000


def _spread_join(big: DataFrame, small: DataFrame, key: str, by: str, rows: int | None = None, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` on ``key``, of which one value may hold most rows of ``big``: its rows go to SALTS places
    by the hash of ``by``, and a row of ``small`` only to the places that need it. Tables known to have few ``rows`` are joined as they are."""
    if rows is not None and rows < SALT_ROWS:
        return big.join(small, key, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    needed = salted.select(key, "__salt").distinct().join(small, key)
    return salted.join(needed, [key, "__salt"], how).drop("__salt")


def link(signed: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate links (``id``, ``leader``: five-word shingles, Jaccard 0.8 or more) among texts with different shingle sets,
    and the classes (``id``, ``class_id``) they make.

    ``signed``: id, n, bands, a row per shingle set; ``texts``: id, text of at least those. Every pair that shares a bucket is
    linked, joined by links between others, or compared and found unlike: in each round some members of every bucket (1, 2, 4,
    ... of it) are compared with all that are not yet in their class, until a bucket is one class or all its members have had
    their turn. Pairs are passed over only where sizes, or the distances of both to the bucket's first member (Jaccard distance
    keeps the triangle inequality), rule a match out. No bucket is gathered: rounds are joins and partial aggregates.
    """
    rows = signed.select("id", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).where("c > 1").select("bucket", "first")
    state = materialise(rows.join(shared, "bucket"), "buckets")
    shingled = F.pandas_udf(_shingle_column, "array<long>")
    sets = materialise(texts.join(state.select("id").distinct(), "id").select("id", shingled("text").alias("set")), "shingles")
    state = state.withColumn("pivot", F.lit(None).cast("double"))
    links = signed.select("id", F.col("id").alias("leader")).where("false")
    classed = links.select("id", F.col("leader").alias("class_id"))
    width = 1
    while True:
        size = state.count()
        grouped = state.join(classed, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")) if width > 1 else state.withColumn("class_id", F.col("id"))
        stats = grouped.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least"), F.min("class_id").alias("__a"), F.max("class_id").alias("__b"))
        turn = F.pmod(F.xxhash64("id", F.lit(width)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("c") < F.lit(width)
        turn = F.col("id") == F.col("first") if width == 1 else (F.col("id") == F.col("least")) | turn
        grouped = _spread_join(grouped, stats.where("__a != __b"), "bucket", "id", size).withColumn("turn", turn)
        grouped = materialise(grouped.select("bucket", "id", "n", "first", "pivot", "class_id", "turn"), "round")
        if grouped.isEmpty():
            return links, classed
        heads = grouped.where("turn").select("bucket", F.col("id").alias("leader"), F.col("n").alias("leader_n"), F.col("class_id").alias("leader_class"), F.col("pivot").alias("leader_pivot"))
        pairs = _spread_join(grouped, heads, "bucket", "id", size)
        pairs = pairs.where((F.col("class_id") != F.col("leader_class")) & (~F.col("turn") | (F.col("leader") < F.col("id"))))
        pairs = pairs.where(F.coalesce(F.abs(F.col("pivot") - F.col("leader_pivot")) <= 1 - SIMILARITY + 1e-9, F.lit(True)))
        likely = (F.least("n", "leader_n") >= F.lit(SIMILARITY) * F.greatest("n", "leader_n")) | F.lit(width == 1)
        pairs = pairs.where(likely).select("id", "leader").distinct()
        compared = _spread_join(pairs.join(sets.withColumnRenamed("set", "a"), "id"), sets.select(F.col("id").alias("leader"), F.col("set").alias("b")), "leader", "id", size)
        compared = compared.withColumn("both", F.size(F.array_intersect("a", "b"))).select("id", "leader", (F.col("both") / (F.size("a") + F.size("b") - F.col("both"))).alias("j"))
        compared = materialise(compared, "compared")
        found = compared.where(F.col("j") >= SIMILARITY).select("id", "leader")
        if not found.isEmpty():
            links = materialise(links.unionByName(found), "links")
            classed = classes(links)
        state = grouped.where("NOT turn").drop("turn", "class_id")
        if width == 1:  # how far each member is from the first of its bucket
            far = compared.select("id", F.col("leader").alias("first"), (1 - F.col("j")).alias("pivot"))
            state = state.drop("pivot").join(far, ["id", "first"], "left")
        state = materialise(state.select("bucket", "id", "n", "first", "pivot"), "buckets")
        width *= 2


def _shingle_column(texts: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([_shingles(t, known) for t in texts], dtype=object)


def copies(texts: DataFrame) -> DataFrame:
    """Links ``id`` -> ``leader`` among ``texts`` (id, text): near copies (see :func:`link`) and texts of one shingle set. Texts without a word have none."""
    sign = F.pandas_udf(_signed, _SIGNED)
    made = materialise(texts.select("id", sign("text").alias("s")).select("id", "s.*").where("n > 0"), "signed")
    least = made.groupBy("set_key").agg(F.min("id").alias("leader"))
    equal = made.join(least, "set_key").where("id != leader").select("id", "leader")
    return link(made.join(least.select(F.col("leader").alias("id")), "id", "left_semi"), texts)[0].unionByName(equal)


def classes(links: DataFrame) -> DataFrame:
    """``id`` and ``class_id`` (least id) of all texts in links, by repeated hooking to the least neighbour's label.

    Each round halves the way to the least id, so there are logarithmically many; a text with very many links is spread over SALTS places.
    """
    edges = materialise(links.select("id", F.col("leader").alias("other")).unionByName(links.select(F.col("leader").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    label = materialise(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("class_id")), "labels")
    size = edges.count()
    while True:
        near = _spread_join(edges, label.select(F.col("id").alias("other"), "class_id"), "other", "id", size).groupBy("id").agg(F.min("class_id").alias("near"))
        hooked = label.join(near, "id").select("id", F.least("class_id", "near").alias("new"), "class_id")
        # a shortcut through the label of one's label
        jump = hooked.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        after = materialise(_spread_join(hooked, jump, "new", "id", size).select("id", F.least("new", "jump").alias("class_id"), F.col("class_id").alias("was")), "labels")
        label = after.select("id", "class_id")
        if after.where("class_id != was").isEmpty():
            return label


# --- belief propagation


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(5)]


def _with_message(df: DataFrame, logs: list[Column], to: str, up: bool) -> DataFrame:
    """Adds ``to``0 .. ``to``4, the log message over an edge: up from an entry to its directory, or down.

    The weights are columns of their own, so that every logarithm and exponential is worked out once and generated code stays short."""
    rest = [F.col(c) for c in df.columns]
    df = df.select(*rest, *[x.alias(f"__l{i}") for i, x in enumerate(logs)])
    df = df.select(*rest, *_cols("__l"), F.greatest(*_cols("__l")).alias("__top"))
    df = df.select(*rest, *[F.exp(F.col(f"__l{i}") - F.col("__top")).alias(f"__w{i}") for i in range(5)])
    out = []
    for t in range(5):
        weights = [GIVEN[t][f] if up else GIVEN[f][t] for f in range(5)]
        total = F.col("__w0") * F.lit(weights[0])
        for f in range(1, 5):
            total = total + F.col(f"__w{f}") * F.lit(weights[f])
        out.append(F.log(total).alias(f"{to}{t}"))
    return df.select(*rest, *out)


def _parent(c: str) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")


def propagate(files: DataFrame, hot_rows: int = 10_000) -> DataFrame:
    """Beliefs ``p0`` .. ``p4`` of files (``id``, ``repo``, ``dir``, log-odds ``e0`` .. ``e4``).

    Two sweeps over each repository's directory tree, level by level. Sums are taken on the map side
    first; directories holding many files reach them by broadcast (no more than a thousand can hold a
    thousandth each), all others by a join.
    """
    files = materialise(_with_message(files.select("id", "repo", "dir", *_cols("e")), _cols("e"), "m", True), "bp-files")
    rows = files.count()
    held = files.groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"m{i}").alias(f"s{i}") for i in range(5)])
    steps = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    held = materialise(held, "bp-held")
    all_dirs = held.select("repo", F.split("dir", "/").alias("parts"), F.col("dir").alias("whole"))
    all_dirs = all_dirs.select("repo", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("whole") != "", steps).otherwise(F.array().cast("array<string>")))).alias("dir")).distinct()

    @F.pandas_udf("array<double>")
    def named(d: pd.Series) -> pd.Series:
        return d.map(lambda x: directory_evidence(x.rsplit("/", 1)[-1]))

    dirs = all_dirs.join(held, ["repo", "dir"], "left").withColumn("v", named("dir"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    dirs = dirs.select("repo", "dir", _parent("dir").alias("parent"), depth.alias("depth"), F.coalesce("n", F.lit(0)).alias("n"),
                       *[(F.coalesce(f"s{i}", F.lit(0.0)) + F.col("v")[i]).alias(f"u{i}") for i in range(5)])
    dirs = materialise(dirs, "bp-dirs")
    deepest = dirs.agg(F.max("depth")).head()[0]
    if deepest is None:
        return files.select("id", *[F.lit(0.0).alias(f"p{i}") for i in range(5)])
    # up: the levels from the deepest, each added to by the one below
    ups: dict[int, DataFrame] = {}
    for level in range(deepest, -1, -1):
        here = dirs.where(F.col("depth") == level)
        if level < deepest:
            below = ups[level + 1].groupBy("repo", F.col("parent").alias("dir")).agg(*[F.sum(f"m{i}").alias(f"b{i}") for i in range(5)])
            here = here.join(below, ["repo", "dir"], "left").select("repo", "dir", "parent", "n", *[(F.col(f"u{i}") + F.coalesce(f"b{i}", F.lit(0.0))).alias(f"u{i}") for i in range(5)])
        ups[level] = materialise(_with_message(here.select("repo", "dir", "parent", "n", *_cols("u")), _cols("u"), "m", True), f"bp-up{level}")
    # down: what the rest of the tree says of each directory
    done = None
    above = None
    for level in range(deepest + 1):
        here = ups[level]
        if above is None:
            here = here.select("repo", "dir", "n", *[(F.col(f"u{i}") + F.lit(math.log(PRIOR[i]))).alias(f"t{i}") for i in range(5)])
        else:
            joined = here.join(above.select("repo", F.col("dir").alias("parent"), *_cols("t")), ["repo", "parent"])
            joined = _with_message(joined, [F.col(f"t{i}") - F.col(f"m{i}") for i in range(5)], "c", False)
            here = joined.select("repo", "dir", "n", *[(F.col(f"u{i}") + F.col(f"c{i}")).alias(f"t{i}") for i in range(5)])
        above = materialise(here, f"bp-down{level}")
        done = above if done is None else done.unionByName(above)
    hot = done.where((F.col("n") >= hot_rows) & (F.col("n") >= F.lit(rows / 1000))).drop("n")
    cold = done.drop("n")
    tagged = files.join(F.broadcast(hot.select("repo", "dir", *[F.col(f"t{i}").alias(f"h{i}") for i in range(5)])), ["repo", "dir"], "left")
    near = tagged.where("h0 IS NOT NULL").select("id", *_cols("e"), *_cols("m"), *[F.col(f"h{i}").alias(f"t{i}") for i in range(5)])
    far = tagged.where("h0 IS NULL").join(cold, ["repo", "dir"]).select("id", *_cols("e"), *_cols("m"), *_cols("t"))
    both = _with_message(near.unionByName(far), [F.col(f"t{i}") - F.col(f"m{i}") for i in range(5)], "c", False)
    both = both.select("id", *[(F.col(f"e{i}") + F.col(f"c{i}")).alias(f"g{i}") for i in range(5)])
    both = both.select("id", *_cols("g"), F.greatest(*_cols("g")).alias("__top")).select("id", *[F.exp(F.col(f"g{i}") - F.col("__top")).alias(f"w{i}") for i in range(5)])
    total = F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")
    # written, so that no filter on the result is pushed through the sums above
    return materialise(both.select("id", *[(F.col(f"w{i}") / total).alias(f"p{i}") for i in range(5)]), "bp-beliefs")


def _looked_at(artifacts: DataFrame) -> DataFrame:
    """One pass over all texts: place, evidence and signature of every artifact; texts themselves go no further."""
    base = artifacts.select("artifact_id", "uri", "path", "content", F.try_element_at("metadata", F.lit("repo")).alias("repo_tag"))

    @F.pandas_udf("repo string, place string, odds array<double>, library string, set_key binary, n int, bands array<long>")
    def look(uri: pd.Series, path: pd.Series, content: pd.Series, tag: pd.Series) -> pd.DataFrame:
        out = []
        for u, p, t, g in zip(uri, path, content, tag):
            repo, where = repository(u, g), location(p, u)
            odds, library = evidence(t, where, repo)
            parts = where.split("/")[:-1]
            for i, x in enumerate(parts):
                if x.lower() in _VENDOR_DIRS and not library:
                    rest = [y for y in parts[i + 1 :] if not re.fullmatch(r"(?i)git\..*|src|lib|sources|v\d+", y)]
                    library = re.sub(r"-\d+(?:\.\d+)*$", "", rest[-1].lower()) if rest else ""
            out.append((repo, where, odds, library))
        return pd.concat([pd.DataFrame(out, columns=["repo", "place", "odds", "library"]), _signed(content)], axis=1)

    return base.select("artifact_id", look("uri", "path", "content", "repo_tag").alias("x")).select("artifact_id", "x.*")


def _grouped(seen: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``set_key``, ``id`` (the least artifact of a shingle set) and ``n`` of all sets with a word; ``id`` and ``class_id`` of those with near copies."""
    keys = materialise(seen.where("n > 0").groupBy("set_key").agg(F.min("artifact_id").alias("id"), F.min("n").alias("n")), "sets")
    signed = seen.select(F.col("artifact_id").alias("id"), "n", "bands").join(keys.select("id"), "id", "left_semi")
    return keys, link(signed, artifacts.select(F.col("artifact_id").alias("id"), F.col("content").alias("text")))[1]


def copy_classes(artifacts: DataFrame) -> DataFrame:
    """``artifact_id`` and ``class_id`` (its least artifact) of every artifact with a word in it: copies and near copies are one class.

    NULL and empty contents, and those without a word, have no row. Repeated contents share their class.
    """
    seen = materialise(_looked_at(artifacts).select("artifact_id", "set_key", "n", "bands"), "signed")
    keys, grouped = _grouped(seen, artifacts)
    named = keys.join(grouped, "id", "left").select("set_key", F.coalesce("class_id", "id").alias("class_id"))
    return _spread_join(seen.where("n > 0").select("artifact_id", "set_key"), named, "set_key", "artifact_id", seen.count()).select("artifact_id", "class_id")


def label_files(artifacts: DataFrame) -> DataFrame:
    """``artifact_id``, ``label``, ``p_handwritten`` for every artifact (artifact_id, uri, path, content, metadata).

    Empty and NULL contents are hand-written (there is nothing else in them). Artifacts without a path use
    that of their address; those without any repository share the tree of their host. An artifact fetched
    again counts again. Contents repeated inside one repository are no sign of copying, and a copy of a text
    of a few words is a weak one.
    """
    seen = materialise(_looked_at(artifacts), "evidence")
    keys, grouped = _grouped(seen, artifacts)
    key_class = keys.join(grouped, "id", "left").select("set_key", "n", F.coalesce("class_id", "id").alias("class_id"))
    # per set: whether several repositories have it, and the library it says it is from
    homes = seen.where("n > 0").groupBy("set_key").agg(F.min(F.xxhash64("repo")).alias("a"), F.max(F.xxhash64("repo")).alias("b"))
    homes = homes.join(key_class, "set_key").groupBy("class_id").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a != b").select("class_id")
    said = seen.where("library != '' AND n > 0").select("set_key", "library").distinct().join(key_class.select("set_key", "class_id"), "set_key")
    spread = said.groupBy("class_id").agg(F.max("library").alias("class_library")).join(homes, "class_id", "left_semi")
    copied = materialise(key_class.join(spread, "class_id").select("set_key", F.col("n").alias("set_n"), "class_library"), "copied")
    files = _spread_join(seen.drop("bands", "n"), copied, "set_key", "artifact_id", seen.count(), "left")
    own = F.array_contains(F.split("repo", "/"), F.coalesce("class_library", F.lit("")))
    weight = F.lit(STRONG) * F.least(F.lit(1.0), F.col("set_n") / 8)
    copy_odds = F.when(F.col("class_library").isNull(), 0.0).when(own, -weight).otherwise(weight)
    odds = [(F.col("odds")[i] + (copy_odds if i == VEND else F.lit(0.0))).alias(f"e{i}") for i in range(5)]
    directory = F.when(F.instr("place", "/") > 0, F.regexp_replace("place", r"/[^/]*$", "")).otherwise("")
    beliefs = propagate(files.select(F.col("artifact_id").alias("id"), "repo", directory.alias("dir"), *odds))
    best = F.greatest(*_cols("p"))
    label = F.lit(LABELS[4])
    for i in (3, 2, 1, 0):
        label = F.when(F.col(f"p{i}") == best, LABELS[i]).otherwise(label)
    return beliefs.select(F.col("id").alias("artifact_id"), label.alias("label"), F.col("p0").alias("p_handwritten"))

