"""DuckDB statements that say independently what each query of :mod:`catalog.queries` returns.

They work on whole tables and whole texts. Byte offsets come from a *shadow* of the text that has one
ASCII character per byte: the first byte of a longer code point is chr(1), the others are chr(2).
"""

from __future__ import annotations

# The label packs the statements need.
DEFAULT_LABELS = [
    "person", "email", "phone", "address", "credit card", "ssn", "account number", "password",
    "username", "ip address", "date", "location", "organization",
]
EXTENDED_LABELS = [
    "person", "name", "first name", "last name", "dob", "age", "gender", "email", "email address",
    "phone", "phone number", "ip address", "url", "address", "location", "street", "city", "state",
    "country", "zip", "account number", "bank account", "routing number", "credit card",
    "card number", "cvv", "ssn", "money", "condition", "medical", "drug", "medication", "blood type",
    "passport", "driver license", "username", "password", "license plate", "organization", "company",
]
PRIVATE_LABELS = [
    "conversation", "private conversation", "direct message", "chat message", "im message",
    "slack message", "zoom chat", "meet transcript", "speaker", "listener",
    "confidential discussion", "customer message", "agent message",
]
LOG_LABELS = [
    "log entry", "stack trace", "exception", "error message", "debug message", "credential", "token",
    "api key", "secret", "session id", "container id", "hostname", "ip address",
]
SCAN_LABELS = DEFAULT_LABELS + [label for label in LOG_LABELS if label != "ip address"]

# Fixed values: (label, portable regex, score) of the pattern scorer, in order.
PATTERNS = [
    ("url", r"https?://[A-Za-z0-9._~:/?#@!$&''()*+,;=%-]+", "0.9"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "0.95"),
    ("phone", r"(?:\+[0-9]{1,3} )?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", "0.8"),
    ("account number", r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "0.65"),
    ("token", r"[0-9a-f]{40}", "0.8"),
    ("O", r"[0-9]+(?:\.[0-9]+){4,}", "1.0"),
    ("ip address", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "0.85"),
    ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "0.75"),
    ("date", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "0.6"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "0.9"),
    ("phone", r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", "0.8"),
    ("phone", r"[0-9]{3}-[0-9]{4}", "0.45"),
    ("credit card", r"[0-9]{4}(?:[ -][0-9]{4}){3}", "0.7"),
    ("O", r"[0-9]{20,}", "1.0"),
    ("credit card", r"[0-9]{13,19}", "0.75"),
    ("account number", r"[0-9]{8,12}", "0.6"),
]
SEARCH = "|".join(f"(?:{pattern})" for _, pattern, _ in PATTERNS)

SPACE = (
    r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def quoted(labels: list[str]) -> str:
    return ", ".join(f"'{label}'" for label in labels)


def trimmed(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def source_cte(table: str, key: str, text: str) -> str:
    return f"""src AS (
  SELECT {key} AS id, {text} AS text,
         regexp_replace(regexp_replace(regexp_replace({text},
           '[\\x{{80}}-\\x{{7FF}}]', chr(1) || chr(2), 'g'),
           '[\\x{{800}}-\\x{{FFFF}}]', chr(1) || chr(2) || chr(2), 'g'),
           '[\\x{{10000}}-\\x{{10FFFF}}]', chr(1) || chr(2) || chr(2) || chr(2), 'g') AS shadow
  FROM {table} WHERE {text} IS NOT NULL)"""


def slice_text(text: str, shadow: str, start: str, length: str) -> str:
    """Text of a byte range: characters are counted by leaving out continuation bytes."""
    before = f"length(replace(substr({shadow}, 1, {start}), chr(2), ''))"
    within = f"length(replace(substr({shadow}, {start} + 1, {length}), chr(2), ''))"
    return f"substr({text}, {before} + 1, {within})"


def chunk_ctes(size: int) -> str:
    return f"""ends AS (
  SELECT id, 0 AS idx, 0 AS pos,
         0 AS until FROM src WHERE FALSE
  UNION ALL
  SELECT id, -1, 0, 0 FROM src
  UNION ALL
  SELECT id, idx + 1, pos, CAST(until AS INTEGER) FROM (
    SELECT id, idx, pos,
           CASE WHEN n - pos <= {size} THEN n
                WHEN nl > 1 THEN pos + nl
                WHEN nl = 0 AND sp > 1 THEN pos + sp
                WHEN substr(shadow, pos + {size} + 1, 1) <> chr(2) THEN pos + {size}
                WHEN substr(shadow, pos + {size}, 1) <> chr(2) THEN pos + {size} - 1
                WHEN substr(shadow, pos + {size} - 1, 1) <> chr(2) THEN pos + {size} - 2
                ELSE pos + {size} - 3 END AS until
    FROM (
      SELECT *, length(regexp_extract(w, '(?s)^(.*\\n)', 1)) AS nl,
             length(regexp_extract(w, '(?s)^(.* )', 1)) AS sp
      FROM (
        SELECT e.id, e.idx, e.until AS pos, s.shadow, length(s.shadow) AS n,
               substr(s.shadow, e.until + 1, {size}) AS w
        FROM ends e JOIN src s ON s.id = e.id
        WHERE e.until < length(s.shadow) OR e.idx = -1)))),
chunks AS (
  SELECT e.id, e.idx, e.pos AS off, e.until - e.pos AS len,
         substr(s.shadow, e.pos + 1, e.until - e.pos) AS shadow,
         {slice_text("s.text", "s.shadow", "e.pos", "(e.until - e.pos)")} AS text
  FROM ends e JOIN src s ON s.id = e.id WHERE e.idx >= 0)"""


def pattern_token_ctes() -> str:
    labels = " ".join(
        f"WHEN regexp_full_match(hit, '{pattern}') THEN '{label}'" for label, pattern, _ in PATTERNS
    )
    scores = " ".join(
        f"WHEN regexp_full_match(hit, '{pattern}') THEN {score}" for _, pattern, score in PATTERNS
    )
    return f"""pieces AS (
  SELECT id, idx, off, unnest(gaps) AS gap, unnest(hits) AS hit,
         generate_subscripts(gaps, 1) AS k
  FROM (SELECT id, idx, off, regexp_split_to_array(text, '{SEARCH}') AS gaps,
               regexp_extract_all(text, '{SEARCH}') AS hits FROM chunks)),
placed AS (
  SELECT id, idx, off, k, gap, hit,
         CAST(coalesce(sum(strlen(gap) + coalesce(strlen(hit), 0)) OVER (
           PARTITION BY id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS INTEGER) AS began
  FROM pieces),
tokens AS (
  SELECT id, idx, off, 2 * k - 1 AS i, began AS s, CAST(began + strlen(gap) AS INTEGER) AS e,
         'O' AS label, CAST(1.0 AS DOUBLE) AS score
  FROM placed
  UNION ALL
  SELECT id, idx, off, 2 * k, CAST(began + strlen(gap) AS INTEGER),
         CAST(began + strlen(gap) + strlen(hit) AS INTEGER),
         CASE {labels} END, CAST(CASE {scores} END AS DOUBLE)
  FROM placed WHERE hit IS NOT NULL)"""


def piece_token_ctes() -> str:
    """Tokens of the letter-piece scorer of the queries."""
    return """pieces AS (
  SELECT id, idx, off, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
  FROM (SELECT id, idx, off, regexp_extract_all(text, '[A-Za-z]{1,3}|[^A-Za-z]') AS toks
        FROM chunks)),
tokens AS (
  SELECT id, idx, off, i, CAST(until - strlen(tok) AS INTEGER) AS s, CAST(until AS INTEGER) AS e,
         CASE WHEN regexp_matches(tok, '^[a-gA-G]') THEN 'person'
              WHEN regexp_matches(tok, '^[h-nH-N]') THEN 'email'
              WHEN regexp_matches(tok, '^[o-tO-T]') THEN 'date'
              WHEN regexp_matches(tok, '^[!-~]') THEN 'O'
              WHEN strlen(tok) = 1 THEN NULL
              ELSE 'person' END AS label,
         CASE strlen(tok) WHEN 1 THEN 0.2 WHEN 2 THEN 0.55 ELSE 0.9 END::DOUBLE AS score
  FROM (SELECT *, sum(strlen(tok)) OVER (PARTITION BY id, idx ORDER BY i) AS until FROM pieces))"""


def span_ctes(labels: list[str], threshold: str = "0.3") -> str:
    return f"""seen AS (
  SELECT *, label <> 'O' AND NOT (CAST(score AS FLOAT) < CAST({threshold} AS FLOAT)) AS hit
  FROM tokens
  WHERE e > s AND label IS NOT NULL AND (label = 'O' OR label IN ({quoted(labels)}))),
marked AS (
  SELECT *, CASE WHEN hit AND lag(hit) OVER w AND lag(label) OVER w = label
                  AND lag(e) OVER w = s THEN 0 ELSE 1 END AS opens
  FROM seen WINDOW w AS (PARTITION BY id, idx ORDER BY i)),
islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY id, idx ORDER BY i) AS island FROM marked),
spans AS (
  SELECT id, idx, any_value(off) AS off, island, any_value(label) AS label,
         min(s) AS s, max(e) AS e, max(score) AS score
  FROM islands WHERE hit GROUP BY id, idx, island)"""


def false_positive(label: str, value: str, score: str, part: str = "all") -> str:
    low = f"lower({trimmed(value)})"
    digit = r"\p{Nd}"

    def any_of(patterns: list[str]) -> str:
        return " OR ".join(f"regexp_matches({low}, '{pattern}')" for pattern in patterns)

    rules = {
        "password": (None, ["password", "pwd", "passwd", "pass"],
                     ["^password$", "^pwd$", rf"password{digit}*$"], None),
        "email": (None, ["email", "emailaddress", "useremail", "e-mail"],
                  ["^email$", "^.*email.*$"], r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "phone": (None, ["phone", "phonenumber", "mobile", "tel", "telephone"],
                  [rf"^iphone{digit}+$", "^phone$", ".*phone.*"], rf"(?:{digit}[^{digit}\n]*){{10}}"),
        "address": (None, ["address", "addr", "location", "phonenumber", "emailaddress",
                           "emailaddressvalue"], ["^address$", "^.*address.*$"], None),
        "credit card": (None, ["card", "creditcard", "visa", "mastercard", "amex", "discover"],
                        ["^.*card.*$", "^visa$", "^mastercard$"], rf"^{digit}{{13,19}}$"),
        "ssn": (None, ["ssn", "socialsecurity", "social"], ["^[a-z]{1,5}$", "^[A-Z][a-z]+$"],
                rf"^{digit}{{3}}-?{digit}{{2}}-?{digit}{{4}}$"),
        "account number": ("0.6", [], [r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-"
                                       r"[0-9a-f]{12}$"], None),
        "ip address": (None, ["prod", "staging", "dev"],
                       [rf"^[a-z]{{2,3}}-[a-z]+-{digit}+$", "^prod-.*$", "^staging-.*$", "^dev-.*$"],
                       rf"^{digit}{{1,3}}\.{digit}{{1,3}}\.{digit}{{1,3}}\.{digit}{{1,3}}$"),
        "username": (None, ["username", "user", "userid", "user_id"],
                     ["^.*uuid$", "^.*_uuid$", "^.*Uuid$"], None),
        "date": ("0.7", [], [], None),
    }
    cases = []
    for name, (minimum, exact, patterns, valid) in rules.items():
        tests = {
            "min": minimum and f"CAST({score} AS FLOAT) < CAST({minimum} AS FLOAT)",
            "exact": exact and f"{low} IN ({quoted(exact)})",
            "pattern": patterns and f"({any_of(patterns)})",
            "valid": valid and f"NOT regexp_matches({value}, '{valid}')",
        }
        chosen = [t for k, t in tests.items() if t and part in ("all", k)]
        cases.append(f"WHEN '{name}' THEN ({' OR '.join(chosen) or 'FALSE'})")
    return f"CASE lower({label}) {' '.join(cases)} ELSE FALSE END"


def entity_ctes(filters: bool = True) -> str:
    keep = f"WHERE NOT ({false_positive('label', 'text', 'score')})" if filters else ""
    return f"""raw AS (
  SELECT p.id, p.idx, p.island, p.label, p.score, p.s + p.off AS s, p.e + p.off AS e,
         {slice_text("c.text", "c.shadow", "p.s", "(p.e - p.s)")} AS text
  FROM spans p JOIN chunks c ON c.id = p.id AND c.idx = p.idx),
entities AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx, island) - 1 AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY id, s, e, label ORDER BY idx, island) AS copy
        FROM raw {keep}) WHERE copy = 1)"""


def scan_ctes(
    table: str, key: str, text: str, labels: list[str] | None = None, size: int = 8000,
    tokens: str | None = None, threshold: str = "0.3", filters: bool = True,
) -> str:
    return "WITH RECURSIVE " + ",\n".join(
        [
            source_cte(table, key, text),
            chunk_ctes(size),
            tokens or pattern_token_ctes(),
            span_ctes(SCAN_LABELS if labels is None else labels, threshold),
            entity_ctes(filters),
        ]
    )


PIECES = dict(labels=["person", "email"], size=1000, tokens=piece_token_ctes(), filters=False)


def results_cte(limit: int) -> str:
    """Per-document results with a size limit in bytes; ``limit_text`` is how messages show it."""
    return f"""results AS (
  SELECT s.id, CASE WHEN strlen(s.text) > {limit} OR {blank('s.text')} THEN 'skipped'
                    ELSE 'success' END AS status,
         coalesce(n, 0) AS pii_count, strlen(s.text) AS file_size_bytes, k AS chunks_processed
  FROM src s
  LEFT JOIN (SELECT id, count(*) AS n FROM entities GROUP BY id) c ON c.id = s.id
  LEFT JOIN (SELECT id, count(*) AS k FROM chunks GROUP BY id) d ON d.id = s.id)"""


def blank(text: str) -> str:
    return f"NOT regexp_matches({text}, '[^{SPACE[1:]}')"


FP_VALUE = """CASE o_orderkey % 15
  WHEN 0 THEN concat('user', o_orderkey, '@mail', o_orderkey % 9, '.example.com')
  WHEN 1 THEN concat('my.email', o_orderkey, '@x.com')
  WHEN 2 THEN concat('(293) 555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))
  WHEN 3 THEN concat('555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))
  WHEN 4 THEN concat('iphone', o_orderkey)
  WHEN 5 THEN lpad(CAST(o_orderkey AS STRING), 16, '4')
  WHEN 6 THEN concat(lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' 1234 5678 9012')
  WHEN 7 THEN concat(lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '-45-6789')
  WHEN 8 THEN concat(substr(md5(CAST(o_orderkey AS STRING)), 1, 8), '-0b1c-4d2e-8f3a-',
                     substr(md5(CAST(o_orderkey AS STRING)), 9, 12))
  WHEN 9 THEN concat('prod-', o_orderkey)
  WHEN 10 THEN concat(o_orderkey % 256, '.', o_orderkey % 200, '.7.', o_orderkey % 100)
  WHEN 11 THEN concat(' PASSWORD', o_orderkey, ' ')
  WHEN 12 THEN CASE o_orderkey % 4 WHEN 0 THEN 'User_ID' WHEN 1 THEN ' Visa'
                                   WHEN 2 THEN 'record_uuid' ELSE 'mailing address' END
  WHEN 13 THEN concat('12345', chr(10), lpad(CAST(o_orderkey AS STRING), 5, '0'))
  ELSE concat(lpad(CAST(o_orderkey AS STRING), 10, '٣'), '') END"""

FP_LABELS = [
    "password", "email", "phone", "address", "credit card", "ssn", "account number", "ip address",
    "username", "date", "email address", "EMAIL",
]
FP_LABEL = (
    "CASE CAST(floor(o_orderkey / 15) AS BIGINT) % 12 "
    + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(FP_LABELS))
    + " END"
)
FP_SCORE = "CAST((o_orderkey * 7) % 100 AS DOUBLE) / 100"


def fp_query(part: str) -> str:
    verdict = false_positive("label", "value", "score", part)
    return f"""SELECT o_orderkey, label, value, {verdict} AS rejected
FROM (SELECT o_orderkey, {FP_VALUE} AS value, {FP_LABEL} AS label, {FP_SCORE} AS score FROM orders)
""".replace("AS STRING", "AS VARCHAR")


REQUEST_NAME = """CASE o_orderkey % 9 WHEN 0 THEN ' Logs ' WHEN 1 THEN 'private' WHEN 2 THEN 'nope'
  WHEN 4 THEN 'Extended' WHEN 5 THEN 'default' WHEN 6 THEN 'LOG_intelligence'
  WHEN 7 THEN 'conversation' WHEN 8 THEN '' END"""
REQUEST_LIST = """concat('Email, email ,ssn,,', o_orderstatus, ' ,', lower(o_orderstatus), ',',
  lower(o_orderpriority), ',', o_orderpriority)"""
BOOL_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'on' WHEN 2 THEN '1' WHEN 3 THEN 'y'
  WHEN 4 THEN '' WHEN 5 THEN 'TRUE' WHEN 6 THEN 'false' ELSE CAST(o_orderkey AS STRING) END"""
NUMBER_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat(' ', o_orderkey, ' ')
  WHEN 1 THEN concat('+', o_orderkey) WHEN 2 THEN concat('-', o_orderkey)
  WHEN 3 THEN concat(o_orderkey, '.5') WHEN 4 THEN concat('x', o_orderkey) ELSE '' END"""


def sql(text: str) -> str:
    """An expression that both engines read, in DuckDB's spelling."""
    return text.replace("AS STRING", "AS VARCHAR")


PROFILE = f"""CASE lower({trimmed('name')})
  WHEN 'default' THEN 'default' WHEN 'extended' THEN 'extended'
  WHEN 'private_conversation' THEN 'private_conversation'
  WHEN 'conversation' THEN 'private_conversation' WHEN 'private' THEN 'private_conversation'
  WHEN 'log_intelligence' THEN 'log_intelligence' WHEN 'logs' THEN 'log_intelligence'
  WHEN 'log' THEN 'log_intelligence' END"""

# Distinct ignoring case, first spelling first, of a list column ``l`` joined by bars.
DISTINCT_JOINED = """(SELECT string_agg(x, '|' ORDER BY i) FROM (
  SELECT x, i, row_number() OVER (PARTITION BY lower(x) ORDER BY i) AS copy
  FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i)) WHERE copy = 1)"""

CUSTOM_LIST = (
    f"[t for t in [{trimmed('x')} for x in string_split({REQUEST_LIST}, ',')] if t <> '']"
)


def pack(labels: list[str]) -> str:
    return f"[{quoted(labels)}]"


RESOLVE = f"""WITH requests AS (
  SELECT o_orderkey, {REQUEST_NAME} AS name,
         CASE WHEN o_orderkey % 7 = 0 THEN {CUSTOM_LIST}
              WHEN o_orderkey % 7 = 1 THEN CAST([] AS VARCHAR[]) END AS custom,
         o_orderkey % 2 = 0 AS ext, o_orderkey % 3 = 0 AS priv, o_orderkey % 5 = 0 AS lg
  FROM orders),
selected AS (
  SELECT o_orderkey, CASE
    WHEN custom IS NOT NULL THEN custom
    ELSE list_concat(list_concat(list_concat(
      CASE coalesce({PROFILE}, 'default') WHEN 'default' THEN {pack(DEFAULT_LABELS)}
        WHEN 'extended' THEN {pack(EXTENDED_LABELS)}
        WHEN 'private_conversation' THEN {pack(PRIVATE_LABELS)} ELSE {pack(LOG_LABELS)} END,
      CASE WHEN ext THEN {pack(EXTENDED_LABELS)} ELSE [] END),
      CASE WHEN priv THEN {pack(PRIVATE_LABELS)} ELSE [] END),
      CASE WHEN lg THEN {pack(LOG_LABELS)} ELSE [] END) END AS l
  FROM requests),
rows AS (SELECT o_orderkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM selected),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey, lower(x) ORDER BY i) AS copy FROM rows),
joined AS (
  SELECT o_orderkey, string_agg(x, '|' ORDER BY i) AS labels, count(*) AS n
  FROM firsts WHERE copy = 1 GROUP BY o_orderkey)
SELECT r.o_orderkey, j.labels, j.n AS n_labels
FROM requests r LEFT JOIN joined j ON j.o_orderkey = r.o_orderkey"""

ENTITY_LIST = """string_agg(label || ':' || s || '-' || e || ':' || text, '; ' ORDER BY ord)"""


def scan_query(table: str, key: str, text: str, alias: str) -> str:
    return f"""{scan_ctes(table, key, text)}
SELECT s.id AS {alias}, 'success' AS status, coalesce(x.n, 0) AS pii_count,
       CAST(strlen(s.text) AS BIGINT) AS file_size_bytes, CAST(k.n AS INTEGER) AS chunks_processed,
       coalesce(x.found, '') AS found
FROM src s
JOIN (SELECT id, count(*) AS n FROM chunks GROUP BY id) k ON k.id = s.id
LEFT JOIN (SELECT id, count(*) AS n, {ENTITY_LIST} AS found FROM entities GROUP BY id) x
  ON x.id = s.id"""


def statements() -> dict[str, str]:
    document_scan = scan_ctes("documents", "doc_id", "text")
    piece_scan = scan_ctes("documents", "doc_id", "text", **PIECES)
    piece_tokens = "WITH RECURSIVE " + ",\n".join(
        [source_cte("documents", "doc_id", "text"), chunk_ctes(1000), piece_token_ctes()]
    )
    page_results = f"""{scan_ctes("pages", "page_id", "html")},
results AS (
  SELECT s.id, 'success' AS status, coalesce(n, 0) AS pii_count
  FROM src s LEFT JOIN (SELECT id, count(*) AS n FROM entities GROUP BY id) c ON c.id = s.id)"""
    out: dict[str, str] = {}

    out["label_packs"] = f"""{document_scan},
packs AS (
  {" UNION ALL ".join(
      f"SELECT '{name}' AS profile, unnest({pack(labels)}) AS label, "
      f"unnest(range({len(labels)})) AS pos"
      for name, labels in [
          ("default", DEFAULT_LABELS), ("extended", EXTENDED_LABELS),
          ("private_conversation", PRIVATE_LABELS), ("log_intelligence", LOG_LABELS)])})
SELECT profile, CAST(pos AS INTEGER) AS pos, p.label, coalesce(n, 0) AS entities
FROM packs p LEFT JOIN (SELECT label, count(*) AS n FROM entities GROUP BY label) c
  ON c.label = p.label"""
    out["profile_lookup"] = (
        f"SELECT o_orderkey, name, {PROFILE} AS profile "
        f"FROM (SELECT o_orderkey, {REQUEST_NAME} AS name FROM orders)"
    )
    out["resolve_labels"] = RESOLVE
    out["dedupe_labels"] = f"""WITH lists AS (
  SELECT o_orderkey, string_split({REQUEST_LIST}, ',') AS l FROM orders),
rows AS (SELECT o_orderkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM lists),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey, lower(x) ORDER BY i) AS copy FROM rows)
SELECT o_orderkey, string_agg(x, '|' ORDER BY i) AS labels FROM firsts WHERE copy = 1
GROUP BY o_orderkey"""
    out["parse_label_list"] = (
        f"SELECT o_orderkey, array_to_string({CUSTOM_LIST}, '|') AS labels FROM orders"
    )
    out["parse_bool"] = sql(
        f"SELECT o_orderkey, lower({trimmed('t')}) IN ('true', '1', 'yes', 'on') AS flag "
        f"FROM (SELECT o_orderkey, {BOOL_TEXT} AS t FROM orders)"
    )
    out["parse_numbers"] = sql(
        f"""SELECT o_orderkey,
  CASE WHEN regexp_full_match(t, '\\+?[0-9]+') THEN TRY_CAST(replace(t, '+', '') AS BIGINT) END
    AS whole,
  CAST(TRY_CAST(t AS FLOAT) AS DOUBLE) AS number
FROM (SELECT o_orderkey, {trimmed('x')} AS t FROM (
  SELECT o_orderkey, {NUMBER_TEXT} AS x FROM orders))"""
    )
    out["settings_merge"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_orderkey % 100) AS INTEGER) ELSE 30 END
    AS threshold_pct,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5000 + 4 AS INTEGER) ELSE 8000 END
    AS chunk_size,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 64 + 1 AS INTEGER) ELSE 8 END AS batch_size,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 200 AS DOUBLE) ELSE 50.0 END
    AS max_file_size,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 ELSE TRUE END AS filter_false_positives
FROM orders"""

    out["ext_filter"] = """SELECT page_id, url,
  lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1)) IN ('txt', 'json', 'xml', 'csv', 'log', 'md', 'py',
    'js', 'java', 'cpp', 'c', 'h', 'html', 'css', 'yaml', 'yml', 'ini', 'conf', 'config', 'sql', 'sh',
    'bash', 'env') AS is_text
FROM pages"""
    out["size_gate"] = """SELECT doc_id, CASE WHEN n > 2097 THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN n > 2097 THEN concat('File too large (',
    printf('%.1f', CAST(CAST(CAST(n AS FLOAT) / 1048576 AS FLOAT) AS DOUBLE)),
    'MB > 0.0MB)') END AS error
FROM (SELECT doc_id, strlen(text) AS n FROM documents)"""
    out["empty_gate"] = f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS lines,
  CAST(count(*) FILTER ({blank('line')}) AS BIGINT) AS blank_lines
FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[A-Za-z.,]', '', 'g') AS line
      FROM documents)
GROUP BY doc_id"""
    out["decode_bytes"] = """SELECT doc_id, md5(CASE doc_id % 4
    WHEN 2 THEN regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') ELSE text END) AS text_md5
FROM documents"""

    for name, table, key, text, size in (
        ("chunk_text", "documents", "doc_id", "text", 512),
        ("chunk_pages", "pages", "page_id", "html", 8000),
        ("chunk_blocks", "pages", "page_id", "html", 256),
    ):
        out[name] = f"""WITH RECURSIVE {source_cte(table, key, text)},
{chunk_ctes(size)}
SELECT id AS {key}, idx AS chunk_idx, off AS "offset", CAST(len AS INTEGER) AS bytes,
       md5(text) AS text_md5 FROM chunks"""
    out["chunk_count"] = f"""WITH RECURSIVE {source_cte("documents", "doc_id", "text")},
{chunk_ctes(2000)}
SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS chunks FROM chunks GROUP BY id"""
    out["tokenise"] = f"""{document_scan}
SELECT id AS doc_id, idx AS chunk_idx, off + s AS token_start, off + e AS token_end, label, score
FROM tokens"""
    out["token_validity"] = f"""{piece_tokens}
SELECT id AS doc_id, count(*) AS tokens,
       count(*) FILTER (e > s AND label IS NOT NULL) AS scored FROM tokens GROUP BY id"""
    out["label_allowed"] = f"""{piece_tokens}
SELECT id AS doc_id, label, count(*) AS tokens,
       count(*) FILTER (lower(label) IN ('person', 'email')) AS allowed
FROM tokens WHERE label IS NOT NULL GROUP BY id, label"""
    out["threshold"] = f"""{piece_tokens}
SELECT id AS doc_id, count(*) AS tokens,
       count(*) FILTER (NOT CAST(score AS FLOAT) < CAST(0.55 AS FLOAT)) AS kept,
       count(*) FILTER (CAST(score AS FLOAT) < CAST(0.55 AS FLOAT)) AS weak
FROM tokens GROUP BY id"""
    vocabulary = pack(DEFAULT_LABELS)
    out["argmax"] = f"""SELECT vec_id, CAST(idx AS INTEGER) AS idx, CAST(best AS DOUBLE) AS score,
  CASE WHEN idx < 13 THEN list_extract({vocabulary}, CAST(idx + 1 AS INTEGER)) END AS label
FROM (SELECT vec_id, best, list_position(v, best) - 1 AS idx
      FROM (SELECT vec_id, v, list_max([x for x in v if NOT isnan(x)]) AS best
            FROM (SELECT vec_id, [CASE WHEN x > 0.25 THEN CAST('nan' AS FLOAT) ELSE x END
                                  for x in embedding] AS v FROM embeddings)))"""
    out["decode_spans"] = f"""{piece_scan}
SELECT id AS doc_id, label, s AS span_start, e AS span_end, score FROM entities"""
    out["dedupe_entities"] = f"""{piece_scan},
coarse AS (
  SELECT id, ord, label, s - s % 64 AS s, e - e % 64 + 64 AS e, text FROM entities),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id, s, e, label ORDER BY ord) AS copy FROM coarse)
SELECT id AS doc_id, label, s AS span_start, e AS span_end, text,
       CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INTEGER) AS ord
FROM ranked WHERE copy = 1"""
    out["entity_text"] = f"""{document_scan}
SELECT id AS doc_id, CAST(ord AS INTEGER) AS ord, label, text, s AS span_start, e AS span_end,
       CAST(round(score * 100) AS INTEGER) AS score_pct FROM entities"""
    out["fp_min_conf"] = fp_query("min")
    out["fp_exact"] = fp_query("exact")
    out["fp_pattern"] = fp_query("pattern")
    out["fp_valid"] = fp_query("valid")
    out["fp_filter"] = fp_query("all")
    out["emit_test"] = f"""{scan_ctes("documents", "doc_id", "text", threshold="0.6", filters=False)}
SELECT id AS doc_id, label, count(*) AS found,
       count(*) FILTER (NOT ({false_positive('label', 'text', 'score')})) AS emitted
FROM entities GROUP BY id, label"""
    out["fp_rule_table"] = out["emit_test"]

    out["scan_documents"] = scan_query("documents", "doc_id", "text", "doc_id")
    out["scan_pages"] = scan_query("pages", "page_id", "html", "page_id")
    out["scan_conversations"] = scan_query(
        "conversations", "conv_id || '/' || turn", "text", "message"
    )
    out["scan_results"] = f"""{scan_ctes("pages", "page_id", "html")}
SELECT s.id AS page_id, 'success' AS status, coalesce(n, 0) AS pii_count,
       CAST(strlen(s.text) AS BIGINT) AS file_size_bytes,
       CAST(k AS INTEGER) AS chunks_processed, CAST(NULL AS VARCHAR) AS error
FROM src s
LEFT JOIN (SELECT id, count(*) AS n FROM entities GROUP BY id) c ON c.id = s.id
LEFT JOIN (SELECT id, count(*) AS k FROM chunks GROUP BY id) d ON d.id = s.id"""
    out["scan_summary"] = f"""{page_results}
SELECT count(*) AS total_files,
       count(*) FILTER (status = 'success' AND pii_count > 0) AS files_with_pii,
       CAST(coalesce(sum(pii_count) FILTER (status = 'success'), 0) AS BIGINT) AS total_pii,
       count(*) FILTER (status = 'error') AS errors FROM results"""
    out["status_counts"] = (
        f"{page_results}\nSELECT status, count(*) AS files FROM results GROUP BY status"
    )
    out["by_label"] = (
        f"{document_scan}\nSELECT label, count(*) AS entities FROM entities GROUP BY label"
    )
    out["top10_per_label"] = f"""{piece_scan},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY ord) AS place,
         count(*) OVER (PARTITION BY id, label) AS n FROM entities)
SELECT id AS doc_id, label, CAST(any_value(n) AS INTEGER) AS entities,
       string_agg(text || ' ' || printf('%.2f', score) || ' ' || CASE
         WHEN CAST(score AS FLOAT) > CAST(0.7 AS FLOAT) THEN 'high'
         WHEN CAST(score AS FLOAT) > CAST(0.5 AS FLOAT) THEN 'medium' ELSE 'low' END,
         '; ' ORDER BY place) AS top,
       CAST(greatest(any_value(n) - 10, 0) AS INTEGER) AS more
FROM ranked WHERE place <= 10 GROUP BY id, label"""
    out["confidence_band"] = f"""{piece_scan}
SELECT id AS doc_id, CASE WHEN CAST(score AS FLOAT) > CAST(0.7 AS FLOAT) THEN 'high'
         WHEN CAST(score AS FLOAT) > CAST(0.5 AS FLOAT) THEN 'medium' ELSE 'low' END AS band,
       count(*) AS entities FROM entities GROUP BY ALL"""
    out["visible_results"] = f"""{page_results}
SELECT id AS page_id, status FROM results WHERE status = 'success' AND pii_count > 0"""
    out["headline"] = f"""{page_results}
SELECT id AS page_id, CASE WHEN status <> 'success' THEN CAST(id AS VARCHAR)
  WHEN pii_count > 0 THEN concat(id, ' (', pii_count, ' entities)')
  ELSE concat(id, ' (no PII detected)') END AS headline FROM results"""
    out["response_json"] = f"""{document_scan}
SELECT s.id AS doc_id, to_json({{'file': CAST(s.id AS VARCHAR), 'status': 'success',
    'entities': coalesce(x.l, []), 'pii_count': coalesce(x.n, 0),
    'file_size_bytes': strlen(s.text), 'chunks_processed': k.n, 'error': NULL}})::VARCHAR AS json
FROM src s JOIN (SELECT id, count(*) AS n FROM chunks GROUP BY id) k ON k.id = s.id
LEFT JOIN (SELECT id, count(*) AS n, list({{'text': text, 'label': label, 'score': score,
             'start': s, 'end': e}} ORDER BY ord) AS l FROM entities GROUP BY id) x
  ON x.id = s.id"""
    known = quoted(sorted({label.lower() for label, _, _ in PATTERNS}))
    out["unsupported_labels"] = f"""SELECT label, count(*) AS requested FROM (
  SELECT unnest(string_split(labels, '|')) AS label FROM ({RESOLVE}))
WHERE lower(label) NOT IN ({known}) GROUP BY label"""
    out["model_scan"] = f"""{scan_ctes("documents", "doc_id", "text", labels=["person", "email"],
                                       size=1000, filters=False, tokens=MODEL_TOKENS)}
SELECT id AS doc_id, label, s AS span_start, e AS span_end,
       CAST(round(score * 1000) AS INTEGER) AS score_mille FROM entities"""
    files = f"""{scan_ctes("documents", "doc_id", "text")},
files AS (
  SELECT id % 8 AS kind, coalesce(n, 0) AS n, k, CAST(strlen(s.text) AS BIGINT) AS bytes,
    CASE id % 8 WHEN 1 THEN concat('_', id, '.txt') WHEN 2 THEN concat('.', id, '.env')
      WHEN 3 THEN concat(id, '.Json') ELSE concat(id, '.log') END AS name
  FROM src s
  LEFT JOIN (SELECT id, count(*) AS n FROM entities GROUP BY id) c USING (id)
  LEFT JOIN (SELECT id, count(*) AS k FROM chunks GROUP BY id) d USING (id))
SELECT name, CASE kind WHEN 5 THEN 'error' WHEN 6 THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN kind IN (5, 6) THEN 0 ELSE n END AS pii_count,
  CASE kind WHEN 5 THEN NULL WHEN 6 THEN 0 ELSE bytes END AS file_size_bytes,
  CAST(CASE WHEN kind IN (5, 6) THEN 0 ELSE k END AS INTEGER) AS chunks_processed,
  CASE kind WHEN 5 THEN 'Unable to decode file' WHEN 6 THEN 'Empty file' END AS why
FROM files WHERE kind <> 7"""
    out["token_spans"] = out["decode_spans"]
    out["scan_files"] = files
    out["scan_stream"] = files
    out["scan_flat"] = f"{files} AND kind <> 3"
    out["scan_path"] = f"""{scan_ctes("documents", "doc_id", "text", size=2_000_000_000)}
SELECT label, count(*) AS entities FROM entities GROUP BY label"""
    out["write_results"] = out["scan_results"]
    out["write_summary"] = f"""{page_results}
SELECT count(*) AS total_files,
       count(*) FILTER (status = 'success' AND pii_count > 0) AS files_with_pii,
       CAST(coalesce(sum(pii_count) FILTER (status = 'success'), 0) AS BIGINT) AS total_pii,
       count(*) FILTER (status = 'error') AS errors FROM results"""
    return out


# Logits of the toy model: four multiples of a token number, modulo 11, over 11.
MODEL_TOKENS = """pieces AS (
  SELECT id, idx, off, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
  FROM (SELECT id, idx, off, regexp_extract_all(text, '[A-Za-z]{1,3}|[^A-Za-z]') AS toks
        FROM chunks)),
numbered AS (
  SELECT *, strlen(tok) * 7 + unicode(tok) % 13 AS t,
         sum(strlen(tok)) OVER (PARTITION BY id, idx ORDER BY i) AS until FROM pieces),
logits AS (
  SELECT *, (t * 3) % 11 AS l0, (t * 4) % 11 AS l1, (t * 5) % 11 AS l2, (t * 6) % 11 AS l3,
         greatest((t * 3) % 11, (t * 4) % 11, (t * 5) % 11, (t * 6) % 11) AS best FROM numbered),
tokens AS (
  SELECT id, idx, off, i, CAST(until - strlen(tok) AS INTEGER) AS s, CAST(until AS INTEGER) AS e,
         CASE WHEN l0 = best THEN 'O' WHEN l1 = best THEN 'person' WHEN l2 = best THEN 'email'
              ELSE 'date' END AS label,
         CAST(best AS DOUBLE) / 11 AS score
  FROM logits)"""
