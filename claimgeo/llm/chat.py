"""Preference formatting of chosen and rejected conversations.

Only DataFrame functions run here. The turns of each conversation are
gathered once (a conversation is one row of the result, so its turns are the
only group that meets); the longest common turn prefix is found by array
functions inside the row and rendered once as the prompt, and the rest of
either side becomes a completion with a mask of what to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat template.
OPEN, HEADER_END, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``(id, turns)``: the turns ``(turn, role, text)`` of each conversation
    in order; null roles and texts are empty."""
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (conversations.select(F.col(id_col).alias("id"), one.alias("one")).groupBy("id")
            .agg(F.array_sort(F.collect_list("one")).alias("turns")))


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit(HEADER_END), turn.text, F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    differ = F.transform(F.zip_with(a, b, lambda x, y: x.role.eqNullSafe(y.role) & x.text.eqNullSafe(y.text)
                                    & x.isNotNull() & y.isNotNull()), lambda same: ~same)
    first = F.array_position(differ, True)
    return F.when(first > 0, first - 1).otherwise(F.size(differ)).cast("int")


def mask(turns: Column) -> Column:
    """Spans ``start:end`` (code points of the rendered completion, ends
    exclusive) to train on: text and closing mark of the trained role's turns."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc.at + F.length(t.role) + (len(OPEN) + len(HEADER_END))
        end = begin + F.length(t.text) + len(CLOSE)
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(t.role == TRAINED_ROLE, F.array_append(acc.spans, span))
                        .otherwise(acc.spans).alias("spans"))

    return F.array_join(F.aggregate(turns, empty, add, lambda acc: acc.spans), ",")


def preferences(pairs: DataFrame) -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask)`` from ``(pair_id, chosen, rejected)`` turn arrays as of
    :func:`turns_of`.

    The prompt is the longest common turn prefix, rendered once; the
    completions are the turns after it. Masks are comma-joined ``start:end``
    spans of the completion (empty: nothing to train on). Equal conversations
    have empty completions; conversations without a common turn an empty
    prompt; a null side counts as one without turns. Turns compare by role and
    text; ties in the turn number are ordered by role, then text, and repeated
    turn rows are repeated turns. A null id is a group of its own. Empty tables
    give an empty result; other columns are ignored, whatever their names.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    df = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    df = df.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    df = df.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("shared"),
                   rest("chosen").alias("c"), rest("rejected").alias("r"))
    return df.select("pair_id", "n_common", rendered(F.col("shared")).alias("prompt"), rendered(F.col("c")).alias("chosen"),
                     rendered(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"),
                     mask(F.col("r")).alias("rejected_mask"))


def stale_reply(turns: Column) -> Column:
    """A rejected version of a conversation: the text of its last assistant
    turn becomes that of the turn before it of the same role (the reply is
    stale), or else of the turn just before (it only echoes); a conversation
    whose first turn is its only reply loses its text."""
    roles = F.transform(turns, lambda t: t.role == TRAINED_ROLE)
    last = F.size(turns) - F.array_position(F.reverse(roles), True).cast("int") + 1
    earlier = F.filter(F.slice(turns, F.lit(1), last - 1), lambda t: t.role == TRAINED_ROLE)
    echo = F.when(last > 1, F.try_element_at(turns, last - 1).text).otherwise(F.lit(""))
    reply = F.when(F.size(earlier) > 0, F.try_element_at(earlier, F.lit(-1)).text).otherwise(echo)
    stale = F.transform(turns, lambda t, i: F.struct(t.turn.alias("turn"), t.role.alias("role"),
                                                     F.when(i == last - 1, reply).otherwise(t.text).alias("text")))
    return F.when(F.array_contains(roles, True), stale).otherwise(turns)


def stale_reply_preferences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preferences of every conversation over its :func:`stale_reply` version."""
    turns = turns_of(conversations, id_col, turn_col, role_col, text_col)
    pairs = turns.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), stale_reply(F.col("turns")).alias("rejected"))
    return preferences(pairs)


def oracle_sql() -> str:
    """The query over ``conversations`` in SQL, turn by turn."""
    nl = "chr(10)"
    show = f"'{OPEN}' || role || {nl} || {{}} || '<|im_end|>' || {nl}"
    return f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
               FROM conversations),
    last AS (SELECT conv_id, max(k) AS k FROM t WHERE role = '{TRAINED_ROLE}' GROUP BY conv_id),
    before AS (SELECT t.conv_id, max(t.k) AS k FROM t JOIN last l ON t.conv_id = l.conv_id AND t.k < l.k
               WHERE role = '{TRAINED_ROLE}' GROUP BY t.conv_id),
    v AS (SELECT t.conv_id, t.k, t.role, t.text,
                 CASE WHEN t.k = l.k THEN coalesce(s.text, e.text, '') ELSE t.text END AS other
          FROM t LEFT JOIN last l USING (conv_id) LEFT JOIN before b USING (conv_id)
          LEFT JOIN t s ON s.conv_id = t.conv_id AND s.k = b.k
          LEFT JOIN t e ON e.conv_id = t.conv_id AND e.k = l.k - 1),
    cut AS (SELECT conv_id, coalesce(min(k) FILTER (text <> other), max(k) + 1) - 1 AS n FROM v GROUP BY conv_id),
    w AS (SELECT v.*, n, {show.format('text')} AS line, {show.format('other')} AS other_line FROM v JOIN cut USING (conv_id)),
    placed AS (SELECT *, sum(CASE WHEN k > n THEN length(line) ELSE 0 END) OVER win AS c_end,
                  sum(CASE WHEN k > n THEN length(other_line) ELSE 0 END) OVER win AS r_end FROM w
           WINDOW win AS (PARTITION BY conv_id ORDER BY k))
    SELECT conv_id AS pair_id, any_value(n)::INT AS n_common,
           coalesce(string_agg(line, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
           coalesce(string_agg(line, '' ORDER BY k) FILTER (k > n), '') AS chosen,
           coalesce(string_agg(other_line, '' ORDER BY k) FILTER (k > n), '') AS rejected,
           coalesce(string_agg((c_end - length(text) - {len(CLOSE)})::BIGINT || ':' || c_end::BIGINT, ',' ORDER BY k)
                    FILTER (k > n AND role = '{TRAINED_ROLE}'), '') AS chosen_mask,
           coalesce(string_agg((r_end - length(other) - {len(CLOSE)})::BIGINT || ':' || r_end::BIGINT, ',' ORDER BY k)
                    FILTER (k > n AND role = '{TRAINED_ROLE}'), '') AS rejected_mask
    FROM placed GROUP BY conv_id"""
