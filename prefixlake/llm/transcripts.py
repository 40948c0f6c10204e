"""Roles of chat transcripts: a hidden Markov model over speaker markers and line features, decoded by Viterbi, then canonical turns."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.shared import written

ROLES = ("system", "user", "assistant")
#: Turns in a row of a transcript; a longer conversation is several rows, which `parse` reads as one, so that no row is unbounded.
TURNS = 256
# Words before a colon or in a mark that name a speaker, and the role that they hint at.
SPEAKERS = {
    "system": "system", "instructions": "system", "context": "system", "sys": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "prompt": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "answer": "assistant", "a": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant",
}
#: Styles of made transcripts: what stands before a turn's text for system, user and assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Instructions: ", "Human: ", "AI: "),
    ("Context: ", "Q: ", "A: "),
    ("### System\n", "### User\n", "### Assistant\n"),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"),
    ("[SYS] ", "[CUSTOMER] ", "[AGENT] "),
)
#: One turn in so many of a made transcript has no marker.
UNMARKED = 12
_MARK = re.compile(r"\s*(?:<\|\s*(\w+)\s*\|>|\[(\w+)\]|#{1,6}\s*(\w+)\s*:?\s*$|\**(\w+)\**\s*:)\s*", re.I)


def _lined(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turns): the turns of each part of a conversation in order, each (turn, role, text, line), where line is its text in one of STYLES, some unmarked."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    known = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    place = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(ROLES) for x in (r, k + 1))), known)
    mark = F.element_at(F.element_at(F.array(*(F.array(*(F.lit(x) for x in s)) for s in STYLES)), (style + 1).cast("int")), place)
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(UNMARKED)) == 0)
    said = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    said = said.withColumn("span", F.floor(F.coalesce("turn", F.lit(0)) / TURNS))
    nth = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text"))
    lined = said.withColumn("part", F.col("span") * (1 << 32) + F.floor((nth - 1) / TURNS)).withColumn("line", F.concat(F.when(bare, F.lit("")).otherwise(mark), "text"))
    return lined.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("turns"))


def transcripts_of(turns: DataFrame) -> DataFrame:
    """(conv_id, part, text) from (conv_id, turn, role, text): turns one after the other in one of STYLES, some unmarked.

    Rows that repeat a turn with role and text are one; turns with one number go by role and text; null texts are empty; a turn
    of any other role than ROLES (tool, function, null) is written as the user's. Each part has TURNS turns at most, and parts
    are numbered in order.
    """
    return _lined(turns).select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("text"))


def line_features(line: str, before: str) -> tuple[int, tuple[str, ...], str]:
    """Hint of a marker (0 none, else 1 + role, or 4 for an unknown name), other features, and the line without the marker."""
    hint, rest = 0, line
    if m := _MARK.match(line):
        role = SPEAKERS.get((m[1] or m[2] or m[3] or m[4]).lower())
        if role:
            hint, rest = 1 + ROLES.index(role), line[m.end() :]
        elif m[1] or m[2]:
            hint = 4
    words = rest.count(" ") + 1 if rest.strip() else 0
    return (
        hint,
        (
            "length:" + ("0" if not words else "8" if words <= 8 else "20" if words <= 20 else "50" if words <= 50 else "more"),
            "end:" + (rest.rstrip()[-1:] if rest.rstrip()[-1:] in (".", "?", "!", ":", ",") else "other"),
            "start:" + ("upper" if rest[:1].isupper() else "mark" if rest[:1] in ("-", "*", "#", ">", "`") else "other"),
            "before:" + ("none" if not before.strip() else "stop" if before.rstrip()[-1] in ".?!" else "open"),
        ),
        rest,
    )


class RoleModel:
    """States are (role, starts a turn). Start, step and feature chances come from counts with smoothing; an empty count gives a model of the markers alone."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.names = [(r, s) for r in range(3) for s in (True, False)]
        n = len(self.names)
        tag = [f"{ROLES[r]}{int(s)}" for r, s in self.names]
        get = lambda kind, a, b: counts.get((kind, a, b), 0)
        start = np.array([get("start", t, "") + (1.0 if s else 1e-6) for t, (_, s) in zip(tag, self.names, strict=True)])
        step = np.array([[get("step", a, b) + (0.5 if s or ROLES[r] in a else 0) for b, (r, s) in zip(tag, self.names, strict=True)] for a in tag])
        prior = lambda r, st, h: (5.0 if h == 1 + r else 0.5 if h == 0 else 0.05) if st else (5.0 if h == 0 else 0.05)
        hint = np.array([[get("hint", t, str(h)) + prior(r, st, h) for h in range(5)] for t, (r, st) in zip(tag, self.names, strict=True)])
        self.start = np.log(start / start.sum())
        with np.errstate(divide="ignore"):
            self.step = np.log(step / step.sum(axis=1, keepdims=True))
            self.step[~np.isfinite(self.step)] = -1e9
        self.hint = np.log(hint / hint.sum(axis=1, keepdims=True))
        names = sorted({b for kind, _, b in counts if kind == "feature"})
        groups = Counter(x.split(":")[0] for x in names)
        total = {(t, g): sum(get("feature", t, x) for x in names if x.startswith(g + ":")) for t in tag for g in groups}
        self.feature = {x: np.log(np.array([(get("feature", t, x) + 0.5) / (total[t, x.split(":")[0]] + 0.5 * groups[x.split(":")[0]]) for t in tag])) for x in names}
        assert n == 6

    def scored(self, text: str) -> tuple[np.ndarray, list[str]]:
        """How well each line of a part fits each state, and the lines without markers. What stands before the part is not looked at."""
        lines = text.split("\n")
        rests, scores, before = [], np.zeros((len(lines), 6)), ""
        for k, line in enumerate(lines):
            hint, features, rest = line_features(line, before)
            scores[k] = self.hint[:, hint]
            for f in features:
                if f in self.feature:
                    scores[k] += self.feature[f]
            rests.append(rest)
            before = line
        return scores, rests

    def transfer(self, text: str) -> np.ndarray:
        """Best scores of the paths through a part, by the state before it and the state at its end."""
        scores, _ = self.scored(text)
        best = self.step + scores[0]
        for own in scores[1:]:
            best = (best[:, :, None] + self.step).max(axis=1) + own
        return best

    def borders(self, transfers: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
        """The states before and at the end of each later part on the best path through all parts, the first of which ends in the states with the scores `first`."""
        best, came = first, []
        for m in transfers:
            paths = best[:, None] + m
            came.append(paths.argmax(axis=0))
            best = paths.max(axis=0)
        state, out = int(best.argmax()), []
        for back in came[::-1]:
            out.append((int(back[state]), state))
            state = out[-1][0]
        return out[::-1]

    def ends(self, text: str) -> np.ndarray:
        """Best scores of the paths through the first part of a conversation, by the state at its end."""
        scores, _ = self.scored(text)
        best = self.start + scores[0]
        for own in scores[1:]:
            best = (best[:, None] + self.step).max(axis=0) + own
        return best

    def roles(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a transcript, by the likeliest path through its lines."""
        return self.parsed(text)[0]

    def parsed(self, text: str, entry: int | None = None, last: int | None = None) -> tuple[list[tuple[str, str]], bool]:
        """`roles` of a part that is entered from the state `entry` and ends in `last`, if these are given; and whether its first turn goes on from the part before."""
        if not text.strip() and entry is None:
            return [], False
        scores, rests = self.scored(text)
        best, came = (self.start if entry is None else self.step[entry]) + scores[0], np.zeros((len(rests), 6), np.int8)
        for k in range(1, len(rests)):
            paths = best[:, None] + self.step
            came[k] = paths.argmax(axis=0)
            best = paths.max(axis=0) + scores[k]
        state = int(best.argmax()) if last is None else last
        states = [state]
        for k in range(len(rests) - 1, 0, -1):
            state = int(came[k][state])
            states.append(state)
        turns: list[tuple[str, list[str]]] = []
        for state, rest in zip(states[::-1], rests, strict=True):
            role, starts = self.names[state]
            if starts or not turns:
                turns.append((ROLES[role], []))
            turns[-1][1].append(rest)
        return [(role, "\n".join(x).strip()) for role, x in turns], entry is not None and not self.names[states[-1]][1]


def rendered(turns: list[tuple[str, str]]) -> str:
    """Canonical form: <|role|>, the text and <|end|> of each turn, one after the other."""
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def fit(turns: DataFrame) -> RoleModel:
    """A model counted over made transcripts of all labelled conversations (conv_id, turn, role, text): what comes to the driver is a count for each state and feature.

    Markers, steps and line features are counted on the transcripts' lines, unmarked turns included; turns of other roles than
    ROLES are left out.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for turns in b.column("turns").to_pylist():
                state, before = "", ""
                for turn in turns:
                    for k, line in enumerate(turn["line"].split("\n")):
                        last, state = state, f"{turn['role']}{int(k == 0)}"
                        seen[("step", last, state) if last else ("start", state, "")] += 1
                        hint, features, _ = line_features(line, before)
                        seen["hint", state, str(hint)] += 1
                        for f in features:
                            seen["feature", state, f] += 1
                        before = line
        yield pa.RecordBatch.from_pydict({**{c: pa.array([key[k] for key in seen], pa.string()) for k, c in enumerate(("kind", "a", "b"))}, "n": pa.array(seen.values(), pa.int64())})

    rows = _lined(turns.filter(F.col("role").isin(*ROLES))).select("turns")
    counts = rows.mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return RoleModel({(r.kind, r.a, r.b): r.n for r in counts})


def parse(transcripts: DataFrame, model: RoleModel, text_col: str = "text", conversation: str | None = None, part: str = "part") -> DataFrame:
    """`transcripts` with roles (array of strings), turns (array of their texts), n_turns, continued and rendered in place of `text_col`.

    Rows with one value of `conversation` are parts of one transcript, in order of `part`; without it each row is one. The path is
    the likeliest through all parts: each later part first gives its best scores by the states at both ends, 36 numbers; from
    these the states at the borders are settled by conversation, and then each part is parsed between its borders. `continued`
    tells that a row's first turn goes on from the row before. A null, empty or blank transcript has no turns.
    """
    new = ("roles", "turns", "n_turns", "continued", "rendered")
    names = [c for c in transcripts.columns if c not in (text_col, *new)]
    rows = transcripts.select(*names, F.col(text_col).alias("__text"))
    if conversation is not None:
        rows = written(rows)
        long = rows.groupBy(F.col(conversation).alias("__conv")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        if long.limit(1).count():
            rows = _with_borders(rows, written(long), model, conversation, part)
    if "__entry" not in rows.columns:
        rows = rows.withColumns({"__entry": F.lit(None).cast("int"), "__last": F.lit(None).cast("int")})

    def apply(batches):
        for b in batches:
            given = zip(*(b.column(c).to_pylist() for c in ("__text", "__entry", "__last")), strict=True)
            found = [model.parsed(x or "", entry, last) for x, entry, last in given]
            made = [
                pa.array([[r for r, _ in t] for t, _ in found], pa.list_(pa.string())),
                pa.array([[x for _, x in t] for t, _ in found], pa.list_(pa.string())),
                pa.array([len(t) for t, _ in found], pa.int64()),
                pa.array([c for _, c in found], pa.bool_()),
                pa.array([rendered(t) for t, _ in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, *new])

    kinds = dict(transcripts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "roles array<string>, turns array<string>, n_turns long, continued boolean, rendered string"])
    return rows.select(*names, "__text", "__entry", "__last").mapInArrow(apply, schema)


def _with_borders(rows: DataFrame, long: DataFrame, model: RoleModel, conversation: str, part: str) -> DataFrame:
    """`rows` with __entry and __last, the states before and at the end of each part of the `long` conversations (null: any)."""
    parts = rows.join(long, F.col(conversation).eqNullSafe(F.col("__conv")), "left_semi")
    kinds = dict(rows.dtypes)

    def score(batches):
        for b in batches:
            texts = [x or "" for x in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(conversation), b.column(part), *(pa.array([f(x).ravel().tolist() for x in texts], pa.list_(pa.float64())) for f in (model.transfer, model.ends))], ["__conv", "__part", "transfer", "ends"])

    scored = parts.select(conversation, part, "__text").mapInArrow(score, f"__conv {kinds[conversation]}, __part {kinds[part]}, transfer array<double>, ends array<double>")

    def settle(pdf):
        pdf = pdf.sort_values("__part")
        found = model.borders([np.reshape(x, (6, 6)) for x in pdf["transfer"][1:]], np.array(pdf["ends"].iloc[0]))
        pdf["__entry"] = pd.array([None, *(a for a, _ in found)], "Int32")
        pdf["__last"] = pd.array([found[0][0], *(b for _, b in found)], "Int32")
        return pdf[["__conv", "__part", "__entry", "__last"]]

    borders = scored.groupBy("__conv").applyInPandas(settle, f"__conv {kinds[conversation]}, __part {kinds[part]}, __entry int, __last int")
    match = F.col(conversation).eqNullSafe(F.col("__conv")) & F.col(part).eqNullSafe(F.col("__part"))
    return rows.join(borders, match, "left").drop("__conv", "__part")
