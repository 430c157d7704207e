"""The oracle's side: the roles of the star-schema tables as common table expressions of ANSI-like SQL."""

from __future__ import annotations

from ..sources.tables import ROLES, spelled

TOKENS = (("US", r"epoch_us(\1)"), ("KEY", r"cast(json_extract_string(\1, '$.k') as bigint)"))
NAMES = {"o": "orders", "cx": "contexts", "cbr": "chargeback_rows", "rfr": "refund_rows", "it": "items", "u": "users", "s": "stores", "sh": "store_hours", "t": "truth", "ev": "events", "lg": "order_log", "sc": "scored"}


def _role(name: str) -> str:
    table, sql = ROLES[name]
    return spelled(sql, TOKENS).replace("{" + table + "}", table)


PRELUDE = "WITH " + ",\n".join(f"{k} AS ({_role(v)})" for k, v in NAMES.items()) + """,
cb AS (SELECT order_id, max(received_us) AS received_us, any_value(category) AS category FROM cbr GROUP BY order_id),
rf AS (SELECT order_id, min(refunded_us) AS refunded_us FROM rfr GROUP BY order_id),
ox AS (SELECT o.*, CASE WHEN cb.order_id IS NULL THEN 0 ELSE 1 END AS is_chargeback, CASE WHEN rf.order_id IS NULL THEN 0 ELSE 1 END AS is_refund FROM o LEFT JOIN cb USING (order_id) LEFT JOIN rf USING (order_id)),
y AS (SELECT sc.*, l.toxic::BIGINT AS y FROM sc JOIN labels l ON l.doc_id = sc.row_id)
"""


def half_up(sql: str) -> str:
    """round(x, n) spelled out half up, as Spark rounds doubles; engines differ at exact ties."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        if sql[i - 1 : i].isalnum() or comma is None or not sql[comma + 1 : j - 1].strip().isdigit():
            out.append(sql[at : i + 6])
            at = i + 6
            continue
        x, n = half_up(sql[i + 6 : comma]), 10 ** int(sql[comma + 1 : j - 1])
        out += [sql[at:i], f"(sign({x})::DOUBLE * floor(abs({x})::DOUBLE * {n} + 0.5::DOUBLE) / {n})"]
        at = j
    return "".join([*out, sql[at:]])


def oracle(body: str) -> str:
    body = half_up(body.strip())
    return PRELUDE + (", " + body[5:].lstrip() if body[:5].upper() == "WITH " else body)
