"""Secret scans: candidate strings judged by a random forest, all in SQL expressions.

A candidate is a run of 16 or more key characters, or of 12 with a digit, a value of 6 or more
printable characters assigned to a secret word, the password of a URL, or a whole private key. Its
features are length, character transitions, dictionary coverage, path marks and the neighbouring
words. A forest trained on labelled findings gives the chance that it is a secret;
the trained trees are written as nested CASE expressions, so scanning stays in the JVM.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "A-Za-z0-9+/_-"
_QUOTE, _BLANK = r"\"\x27`", r"\x00-\x20\x7f\x85\xa0\u2028\u2029\u3000"
_GAP = rf"[ \t=:>{_QUOTE}]"
_NAMES = r"(?<![a-z])pass|password|passwords|passwd|passphrase|passcode|pwd|secret|token|apikey|api[ _-]key|accesskey|access[ _-]key|secretkey|secret[ _-]key|privatekey|private[ _-]key|signingkey|signing[ _-]key|clientkey|client[ _-]key|encryptionkey|encryption[ _-]key|credential|credentials|auth|authorization|bearer"


def _after_name() -> str:
    """Lookbehinds for a secret word and up to 12 characters of spaces, quotes and signs, each of one width (all that Python's re takes)."""
    widths: dict[int, list[str]] = {}
    for name in _NAMES.split("|"):
        widths.setdefault(len(name.replace("(?<![a-z])", "").replace("[ _-]", " ")), []).append(name)
    named = lambda k: "|".join(f"(?<=(?i:{'|'.join(names)}){_GAP}{{{k}}})" for _, names in sorted(widths.items()))
    return "(?:" + "|".join(f"(?<=[A-Za-z]{_GAP}{{{k}}})(?:{named(k)})" for k in range(1, 13)) + ")"


#: A private key from BEGIN to END; where END is missing, the header and the base64 lines after it.
_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{1,4}+[^-]++){0,64}+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s++[A-Za-z0-9+/=]{40,}+){1,500}+(?:\r?\n[A-Za-z0-9+/]{1,63}+={0,2}(?![^\r\n]))?)?"
#: Whatever stands in quotes, or else without blanks, behind a secret word and '=', ':' or a quote. An auth scheme is no value.
_QUOTED = "|".join(rf"(?<={q})(?![{_BLANK}:=,)\]}}])[^{q}\r\n]{{6,}}+(?={q})" for q in ('"', r"\x27", "`"))
_NEXT = "(?![,;&][A-Za-z_][A-Za-z0-9_]*+[=:])"
_BARE = rf"(?!{_GAP})(?:{_NEXT}[^{_BLANK}]){{5,}}{_NEXT}[^{_BLANK}{_QUOTE},;.)\]}}>]"
_SIGN = rf"(?:(?<=[=:>{_QUOTE}])|" + "|".join(rf"(?<=[=:>][ \t]{{{k}}})" for k in range(1, 12)) + ")"
_ASSIGNED = rf"(?<={_GAP}){_SIGN}{_after_name()}(?!(?i:bearer|basic|digest|token)(?![^{_BLANK}{_QUOTE}:=]))(?:{_QUOTED}|{_BARE})"
_SCHEME = rf"(?<= )(?:(?<=(?i:authorization: bearer ))|(?<=(?i:authorization: basic ))|(?<=(?i:authorization: token )))[^{_BLANK}{_QUOTE},;]{{6,}}+"
#: The password of scheme://user:password@host.
_URL = rf"(?<=:)(?![/:])[^{_BLANK}{_QUOTE}/@<>]{{3,}}+(?=@[A-Za-z0-9\[])"
#: Base64 padding, not the '=' of an assignment.
_PADDING = rf"(?:={{1,2}}(?![^{_BLANK}{_QUOTE},;.)\]}}]|[{_QUOTE}][^{_BLANK}{_QUOTE},;:.)\]}}]))?"
_RUN = rf"(?<![{_KEY}])(?:(?=[A-Za-z+/_-]*+[0-9])[{_KEY}]{{12,}}+|[{_KEY}]{{16,}}+){_PADDING}"
CANDIDATE = "|".join((_PEM, _ASSIGNED, _SCHEME, _URL, _RUN))
MASK = "[SECRET]"
_AROUND = 48
#: Common English and technical words of four letters or more, for dictionary coverage.
DICTIONARY = (
    "about access account action active address admin after agent alpha apple array author avatar back base beta between block board body book border branch brand bridge browser buffer build button cache call center change channel chart check child city class clean click client close cloud code color column commit common company config content control copy core count country cover create data database date default delete delta demo design detail device digest direct document domain down draft edit email engine entry error event example export feature field file filter final first font footer form format forum function gallery game global graph green group guide handle header health height hello help history home host house image import index info input install item join just keep label language last layer layout left length level library light line link list live load local login logo long mail main manager market master media member menu message method mobile mode model module month more name native network news next node note number object offer office open option order output package page panel parent part patch path people phone photo picture place plan player plugin point policy post power press preview price print private process product profile program project public query quick random range rate read record region release remote report request reset resource response result review right root route sample save scale schema scope script search section secure select server service session setting share shop side sign simple single site size small social sort source space spec speed stack staff stage standard start state static status step stock storage store story stream string style submit support switch system table target task team temp template test text theme this thread time title tool topic track traffic trial type under unit update upload user value version video view wait watch water week white widget width window with word work world write year zone"
).split()
_SECRET_WORDS = r"pass(?:words?|wd|phrase|code)?|pwd|secret(?:[ _-]?key)?|token|api[ _-]?key|access[ _-]?key|private(?:[ _-]?key)?|credentials?|bearer|auth(?:orization)?|signing(?:[ _-]?key)?|encryption[ _-]?key|client[ _-]?key|://[^/@:?# ]*:(?!.)"
_PLAIN_WORDS = r"sha-?[0-9]*|md5|checksum|hash|digest|commit|revision|uuid|guid|etag|integrity|build|version|isbn|serial|order|invoice|tracking|ticket|article|doi|page|ref"

#: Feature name and SQL over {v} the candidate, {b} and {a} the text before and after it.
FEATURES = (
    ("n", "length({v})"),
    ("transitions", "(regexp_count({v}, '[a-z](?=[^a-z])') + regexp_count({v}, '[A-Z](?=[^A-Z])') + regexp_count({v}, '[0-9](?=[^0-9])') + regexp_count({v}, '[^A-Za-z0-9](?=[A-Za-z0-9])')) / greatest(length({v}) - 1, 1)"),
    ("digits", "(length({v}) - length(translate({v}, '0123456789', ''))) / length({v})"),
    ("uppers", "(length({v}) - length(translate({v}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / length({v})"),
    ("marks", "(length({v}) - length(translate({v}, '+/_-', ''))) / length({v})"),
    ("hexadecimal", "cast({v} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' as int)"),
    ("distinct", "size(array_distinct(split({v}, ''))) / least(length({v}), 64)"),
    ("runs", "regexp_count({v}, '(.)\\\\1\\\\1') / length({v})"),
    ("dictionary", "1 - length(regexp_replace(lower({v}), '" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + "', '')) / length({v})"),
    ("path", "regexp_count({v}, '/') / length({v}) + cast({b} rlike '(?:[/\\\\\\\\.?&#]|://[^ ]*)$' as int)"),
    ("uuid", "cast({v} rlike '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$' as int)"),
    ("issued", "cast({v} rlike '^(?:-----BEGIN|AKIA|ASIA|gh[pousr]_|sk[-_](?:live|test|proj)|xox[abprs]-|AIza|eyJ|glpat-|npm_)' as int)"),
    ("placeholder", "cast(lower({v}) rlike 'example|xxxx|changeme|your[-_]|dummy|placeholder|redacted|12345678|abcdef01' as int)"),
    ("assigned", "cast({b} rlike '[=:]>?\\\\s*[\"\\'`]?$' as int)"),
    ("quoted", "cast({b} rlike '[\"\\'`]$' and {a} rlike '^[\"\\'`]' as int)"),
    ("secret_word", f"cast(lower({{b}}) rlike '(?:{_SECRET_WORDS})[^a-z]{{{{0,12}}}}$' as int)"),
    ("secret_near", f"cast(lower({{b}}) rlike '(?:{_SECRET_WORDS})' as int)"),
    ("plain_word", f"cast(lower({{b}}) rlike '(?<![a-z])(?:{_PLAIN_WORDS})[^a-z]{{{{0,12}}}}$' as int)"),
)


#: Set around candidates for one pass of the pattern; texts that hold it themselves take two passes.
_EDGE = "\uf8ff"


def parts(text: str) -> str:
    """SQL array of the pieces of a text expression: every second one, from the second on, is a candidate."""
    pattern = CANDIDATE.replace("\\", "\\\\")
    once = f"split(regexp_replace({text}, '{pattern}', '{_EDGE}$0{_EDGE}'), '{_EDGE}', -1)"
    between = f"split({text}, '{pattern}', -1)"
    twice = f"transform(array({between}), s -> concat(flatten(transform(regexp_extract_all({text}, '{pattern}', 0), (v, i) -> array(s[i], v))), slice(s, -1, 1)))[0]"
    return f"if(instr({text}, '{_EDGE}') = 0, {once}, {twice})"


def placed(pieces: str, text: str) -> str:
    """SQL array of (value, before, after, start) for all candidates among the pieces of a text expression.

    before and after are what stands next to the value in the whole text, other candidates included.
    """
    n = f"(size({pieces}) div 2)"
    values = f"transform(slice(sequence(0, {n}), 2, {n}), k -> named_struct('value', {pieces}[2 * k - 1], 'start', aggregate(slice({pieces}, 1, 2 * k - 1), 0L, (n, t) -> n + length(t))))"
    before = f"substring({text}, cast(greatest(c.start - {_AROUND}, 0) + 1 as int), cast(least(c.start, {_AROUND}) as int))"
    after = f"substring({text}, cast(c.start + length(c.value) + 1 as int), {_AROUND})"
    return f"transform({values}, c -> named_struct('value', c.value, 'before', {before}, 'after', {after}, 'start', c.start))"


def candidates(text: str) -> str:
    """SQL array of (value, before, after, start) for all candidates of a text expression."""
    return f"transform(array({parts(text)}), p -> {placed('p', text)})[0]"


def featured(found: str) -> str:
    """SQL array of candidates with their features added."""
    fields = ", ".join(f"'{n}', cast({e.format(v='c.value', b='c.before', a='c.after')} as double)" for n, e in FEATURES)
    return f"transform({found}, c -> named_struct('value', c.value, 'start', c.start, 'f', named_struct({fields})))"


class Forest:
    """Gini trees on bootstrap samples with random feature subsets, as nested tuples."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tries = max(2, int(np.sqrt(x.shape[1])) + 1)
        self.depth = depth
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))

    def _grow(self, x, y, depth, rng):
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return float(y.mean())
        best, tried = (np.inf, 0, 0.0), 0
        for f in rng.permutation(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > 24:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 24).astype(int)]
            side = x[:, f][:, None] <= cuts
            n = side.sum(0)
            ones = (side * y[:, None]).sum(0)
            other = y.sum() - ones
            cost = ones * (1 - ones / n) + other * (1 - other / (len(y) - n))
            k = int(np.argmin(cost))
            best = min(best, (float(cost[k]), int(f), float(cuts[k])))
            tried += 1
            if tried >= self.tries:
                break
        if best[0] == np.inf:
            return float(y.mean())
        side = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[side], y[side], depth - 1, rng), self._grow(x[~side], y[~side], depth - 1, rng))

    def predict(self, x: Sequence[float]) -> float:
        def walk(t):
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            return t

        return sum(map(walk, self.trees)) / len(self.trees)

    def sql(self, features: str) -> str:
        def walk(t):
            if not isinstance(t, tuple):
                return f"{t!r}D"
            return f"CASE WHEN {features}.{FEATURES[t[0]][0]} <= {t[1]!r}D THEN {walk(t[2])} ELSE {walk(t[3])} END"

        return "(" + " + ".join(map(walk, self.trees)) + f") / {len(self.trees)}D"


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """(value, before, after, label) findings, half of them secrets, made from a seed.

    They stand in for findings that reviewers have labelled; pass your own rows to fit().
    """
    rng = random.Random(seed)
    of = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexa, word = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = word + word.upper() + "0123456789"
    prose = lambda: " ".join(of(word, rng.randint(2, 9)) for _ in range(rng.randint(2, 5)))
    marked = mixed + "!#$%&*?@^~.,;+/_-"
    names = ("password", "passwd", "pwd", "secret", "token", "api_key", "client_secret", "PASSWORD", "DB_PASSWORD", "passphrase", "secret_key", "SECRET_ACCESS_KEY", "AUTH_CLIENT_SECRET", "auth_token")
    full = lambda: " ".join(prose() for _ in range(8)) + " "  # noqa: E731; fills the context, as running text does
    url = lambda: full() + rng.choice(("postgres", "mysql", "https", "redis", "amqp", "mongodb+srv")) + "://" + of(word, rng.randint(0, 8))
    out = []
    for k in range(n):
        if k % 2 and rng.random() < 0.35:
            kind, before, after = rng.randrange(5), full(), " " + prose()
            if kind == 0:
                head = rng.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
                body = "\n".join(of(mixed + "+/", 64) for _ in range(rng.randint(1, 26)))
                value = f"-----BEGIN {head}PRIVATE KEY-----" + rng.choice(("", f"\n{body}", f"\n{body}\n-----END {head}PRIVATE KEY-----", f"\n{body}\n-----END {head}PRIVATE KEY-----"))
                before, after = before + rng.choice(("", "\n", "key = \"")), rng.choice((after, "\n", ""))
            elif kind == 1:
                value, before, after = of(mixed, rng.randint(6, 20)) + of("!#$%&*?~", rng.randint(0, 2)), url() + ":", "@" + of(word, 6) + "/" + of(word, 4)
            else:
                value = rng.choice((lambda: of(marked, rng.randint(6, 24)), lambda: of(mixed, rng.randint(6, 16)), lambda: of(word, rng.randint(4, 9)).capitalize() + of("0123456789", rng.randint(1, 4)) + rng.choice(("", "!", "?", "#")), lambda: of(word, rng.randint(3, 8)) + of("0123456789", rng.randint(2, 4))))()
                quote = rng.choice(("", "\"", "\"", "'"))
                if quote and rng.random() < 0.3:
                    value = rng.choice((" ", "-", "")).join(of(word, rng.randint(3, 8)) for _ in range(rng.randint(2, 5)))
                before, after = before + rng.choice(names) + rng.choice(("=", " = ", ": ", ":")) + quote, quote + after
            out.append((value, before[-_AROUND:], after[:_AROUND], 1))
            continue
        if not k % 2 and rng.random() < 0.25:
            kind, before, after = rng.randrange(5), full(), " " + prose()
            if kind == 0:  # the name of a value, or one joined of words
                value = rng.choice(("S3_SECRET_ACCESS_KEY", "AUTH0_CLIENT_SECRET", "AWS_S3_ACCESS_TOKEN", "OAUTH2_CLIENT_SECRET", "_".join((of(word.upper(), 4), "DB2", rng.choice(DICTIONARY).upper(), rng.choice(("PASSWORD", "TOKEN", "SECRET"))))))
                before += rng.choice(("", "export ", "\n"))
            elif kind == 1:  # plain words behind a secret word, in prose
                value, before = rng.choice((rng.choice([w for w in DICTIONARY if len(w) > 5]), of(word, rng.randint(6, 10)))), before + rng.choice(names) + rng.choice((": ", " : "))
            elif kind == 2:
                value, before = rng.choice(("changeme", "example", "your-password", "xxxxxxxx", "placeholder", "redacted", "dummy-value", "example-token")), before + rng.choice(names) + rng.choice(("=", ": ", " = \"", "='"))
                after = (before[-1] if before[-1] in "\"'" else "") + after
            elif kind == 3:  # the address behind a scheme or a label
                value, before, after = of(word, rng.randint(3, 10)), before + rng.choice(("mailto:", "Email:", "to:", "contact:", "sip:")), "@" + of(word, 7) + ".org"
            else:  # URLs with a port or a query
                value, before = rng.choice(("/".join(of(word, 6) for _ in range(3)) + "/" + of("0123456789", 4), of(mixed, rng.randint(16, 30)))), url() + rng.choice((".com:8080/", ".org/page?v=", ".net/a#id=", ".org:443/img/"))
            out.append((value, before[-_AROUND:], after[:_AROUND], 0))
            continue
        if k % 2 and rng.random() < 0.2:  # without a digit, or short
            letters = word + word.upper()
            value = rng.choice((lambda: of(letters, rng.randint(16, 48)), lambda: of(letters + "+/", rng.randint(20, 44)), lambda: of(word, rng.randint(16, 40)), lambda: of(letters + "-_", rng.randint(16, 40)), lambda: of(mixed, rng.randint(12, 15))))()
            before = full() + rng.choice(names) + rng.choice(("=", " = ", ": ", "=\"", " = \"", " = '", "\": \""))
            after = ("\"" if before.endswith("\"") else "'" if before.endswith("'") else "") + " " + prose()
            out.append((value, before[-_AROUND:], after[:_AROUND], 1))
            continue
        if k % 2:
            value = rng.choice([lambda: of(hexa, rng.choice((16, 18, 20, 24, 32, 40, 48, 64))), lambda: of(mixed, rng.randint(16, 64)), lambda: of(mixed + "+/", rng.randint(20, 64)) + rng.choice(("", "=", "==")), lambda: rng.choice(("AKIA", "ASIA")) + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: rng.choice(("ghp_", "gho_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_")) + of(mixed, rng.randint(20, 36)), lambda: "eyJ" + of(mixed, rng.randint(20, 60))])()
            name = rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access key", "auth_token", "client_secret", "PASSWORD", "Authorization: Bearer", "private key", "credential"))
            before = full() + name + rng.choice(("=", " = ", ": ", ":", "=\"", " = \"", " = '", " ", " is ", "\": \""))
            issued = value.startswith(("AKIA", "ASIA", "gh", "sk_", "xox", "AIza", "glpat", "npm_"))
            if issued and rng.random() < 0.4:
                before = full()
            after = ("\"" if before.endswith("\"") else "'" if before.endswith("'") else "") + " " + prose()
            out.append((value, before[-_AROUND:], after[:_AROUND], 1))
            continue
        kind = rng.randrange(13)
        before, after = full(), " " + prose()
        if kind == 9:  # long words
            value = "".join(of("bcdfghjklmnprstvwz", rng.randint(1, 2)) + of("aeiou", rng.randint(1, 2)) for _ in range(rng.randint(6, 12)))[:28].ljust(16, "e")
            value = rng.choice((value, value, value.capitalize(), value.upper()))
        elif kind == 10:  # rules of marks, and words joined by marks
            value = rng.choice((rng.choice("-_/+") * rng.randint(16, 80), rng.choice("-_").join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))), "/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 7)))))
            value = value.ljust(16, "s")
        elif kind == 11:  # telephone numbers, dates, numbered names
            number = lambda n: of("0123456789", n)
            value = rng.choice((f"555-{number(3)}-{number(4)}", f"+{number(2)}-{number(2)}-{number(4)}-{number(4)}", f"20{number(2)}-0{number(1)}-1{number(1)}T1{number(1)}", f"INV-20{number(2)}-{number(5)}", f"{rng.choice(DICTIONARY)}-{rng.choice(DICTIONARY)}-{number(2)}".ljust(12, "0"), number(rng.randint(12, 15))))
            before += rng.choice(("", "", "call ", "tel: ", "on ", "invoice ", "no. "))
        elif kind == 12:  # prose with capitals inside
            value = "".join(rng.choice(DICTIONARY).capitalize() for _ in range(rng.randint(3, 6))).ljust(16, "s")
        elif kind == 0:
            value, before = of(hexa, rng.choice((32, 40, 64))), before + rng.choice(("sha256:", "md5 ", "commit ", "checksum = ", "digest: ", "revision ", "integrity=\"", "etag: \"", "hash="))
        elif kind == 1:
            value, before = "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), before + rng.choice(("uuid ", "id=", "guid: ", "", "request "))
        elif kind == 2:
            value, before = "/".join(rng.choice(DICTIONARY) for _ in range(4)) + "/" + of("0123456789", 4), before + rng.choice(("https://", "/", "./", "http://www."))
        elif kind == 3:
            value = rng.choice("_-").join([*(rng.choice(DICTIONARY) for _ in range(3)), str(rng.randint(1, 2030))])
        elif kind == 4:
            value, before = of("0123456789", rng.randint(16, 30)), before + rng.choice(("order ", "isbn ", "serial: ", "invoice=", "tracking ", "", "number "))
        elif kind == 5:
            value, before = rng.choice(("x" * 20 + "1", "your-api-key-goes-here-1", "example_token_123456", "EXAMPLEKEY00000000000", "changeme-changeme-1234", "0" * 32, "1234567890abcdef1234")), before + rng.choice(("token = \"", "password=", "api_key: ", "secret="))
            after = ("\"" if before.endswith("\"") else "") + after
        elif kind == 6:
            value = f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}"
        elif kind == 7:
            value = of(word, rng.randint(12, 24)) + str(rng.randint(0, 99))
        else:
            value, before = of(mixed, rng.randint(16, 40)), before + rng.choice(("https://cdn/", "page?v=", "img/", "#", "ref "))
        out.append((value, before[-_AROUND:], after[:_AROUND], 0))
    return out


def fit(spark: SparkSession, findings: Sequence[tuple[str, str, str, int]] | None = None, max_rows: int = 4000, trees: int = 20, depth: int = 5) -> Forest:
    """A forest from at most max_rows labelled findings (value, before, after, label); the bound is on fitting only."""
    rows = list(labelled_findings() if findings is None else findings)[:max_rows]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, value string, before string, after string, y int")
    found = "array(named_struct('value', value, 'before', before, 'after', after, 'start', 0L))"
    got = given.selectExpr("i", "y", f"{featured(found)}[0].f AS f").collect()
    got.sort(key=lambda r: r.i)
    return Forest(np.array([list(r.f) for r in got], dtype=float), np.array([r.y for r in got], dtype=float), trees, depth)


#: Helper columns, under names that tables do not use.
_FOUND, _SCAN, _PARTS, _NEW = (f"__graphloom_{n}" for n in ("found", "scan", "parts", "new"))


def _scored(df: DataFrame, forest: Forest, text: str, threshold: float) -> DataFrame:
    """df with the pieces of a text and an array column of judged candidates (value, start, features, score, secret)."""
    out = df.withColumn(_PARTS, F.expr(parts(text))).withColumn(_FOUND, F.expr(featured(placed(_PARTS, text))))
    out = out.withColumn(_FOUND, F.expr(f"transform({_FOUND}, c -> named_struct('value', c.value, 'start', c.start, 'f', c.f, 'score', {forest.sql('c.f')}))"))
    return out.withColumn(_FOUND, F.expr(f"transform({_FOUND}, c -> named_struct('value', c.value, 'start', c.start, 'f', c.f, 'score', c.score, 'secret', c.score >= {threshold!r}D))"))


def scan_secrets(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, start, n_chars, kind, score, is_secret, value_sha256.

    start counts characters from 0. A null or empty text has no candidates; null ids stay null;
    repeated rows give repeated findings; an empty table gives none; other columns are not read.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    # the plain explode would have its array computed once more, for a filter on its size
    rows = _scored(src, forest, "_text", threshold).select("doc_id", F.explode_outer(_FOUND).alias("c")).where("c IS NOT NULL")
    kind = F.when(F.col("c.value").startswith("-----BEGIN"), "private-key").when(F.col("c.f.issued") == 1, "issued").when(F.col("c.f.hexadecimal") == 1, "hex").otherwise("mixed")
    return rows.select("doc_id", F.col("c.start").alias("start"), F.length("c.value").alias("n_chars"), kind.alias("kind"), F.round("c.score", 6).alias("score"), F.col("c.secret").alias("is_secret"), F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"))


def mask_secrets(df: DataFrame, forest: Forest, text_col: str = "text", n_chars_col: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """df, all rows and columns, with each secret of a text replaced by [SECRET].

    Where a text changed, n_chars_col (if df has it) is set to its new length. Null texts stay.
    """
    columns = df.columns
    masked = f"array_join(transform({_PARTS}, (p, i) -> CASE WHEN i % 2 = 1 AND {_FOUND}[cast(i div 2 as int)].secret THEN '{MASK}' ELSE p END), '')"
    out = _scored(df.withColumn(_SCAN, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), forest, _SCAN, threshold)
    out = out.withColumn(_NEW, F.when(F.exists(_FOUND, lambda c: c["secret"]), F.expr(masked)))
    values = {text_col: F.coalesce(_NEW, F.col(f"`{text_col}`"))}
    if n_chars_col in columns:
        kind = df.schema[n_chars_col].dataType
        values[n_chars_col] = F.when(F.col(_NEW).isNotNull(), F.length(_NEW).cast(kind)).otherwise(F.col(f"`{n_chars_col}`"))
    return out.withColumns(values).select(*(F.col(f"`{c}`") for c in columns))
