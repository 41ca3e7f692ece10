"""Chat formatting by schema fingerprints.

The nested field paths of a record, sorted and hashed, are its fingerprint. A registry maps fingerprints to
declarative mappings, so records of prompt, instruction, message and turn layouts all become canonical turns
(role, text). A fingerprint that isn't registered is looked up once: it gets the layout of which it has all paths (an
empty list or null stands for all paths below it) and which has the most of them; further paths don't matter. Turns are written with a template whose control strings cannot stand inside a text: there, each
control string gets a backslash after its first character (one more if it has some), which reading takes away.
The loss mask covers the texts of assistant turns.

Defined cases: null texts and roles are empty; an empty list has no turns; a record of an unknown layout raises ValueError with its paths, or
is left out with strict=False; turns of one number stand in order of role, then text; repeated rows are repeated
turns; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.shared import arrow, batch

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = rf"([\[<])(\\*)({_TAILS})"
_UNESCAPE = rf"([\[<])\\(\\*)({_TAILS})"
#: What stands before and after the text of a turn, by role; any other role is written out.
TEMPLATES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE][TURN] ", " [/TURN]")
LOSS = "assistant"

# ---- layouts -------------------------------------------------------------------------------------------------

#: Mappings by layout. turns: a list to walk, with the paths of role and text in it; or fixed (role, path) pairs,
#: a system turn that is absent or empty being left out; key and order: where a record has its conversation and its turn.
#: ROLES: other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}
LAYOUTS: dict[str, tuple[dict, tuple[str, ...]]] = {
    "turn-row": ({"fixed": [("$role", "text")], "key": "conv_id", "order": "turn"}, ("conv_id", "role", "text", "turn")),
    "messages": ({"list": "messages", "role": "role", "text": "content"}, ("messages[].content", "messages[].role")),
    "message-texts": ({"list": "messages", "role": "role", "text": "text"}, ("messages[].role", "messages[].text")),
    "message-parts": ({"list": "messages", "role": "role", "text": "content[].text"}, ("messages[].content[].text", "messages[].content[].type", "messages[].role")),
    "sharegpt": ({"list": "conversations", "role": "from", "text": "value"}, ("conversations[].from", "conversations[].value")),
    "instruction": ({"fixed": [("user", "instruction"), ("assistant", "output")]}, ("instruction", "output")),
    "instruction-input": ({"fixed": [("user", ("instruction", "input")), ("assistant", "output")]}, ("input", "instruction", "output")),
    "instruction-response": ({"fixed": [("user", ("instruction", "context")), ("assistant", "response")]}, ("context", "instruction", "response")),
    "prompt-completion": ({"fixed": [("user", "prompt"), ("assistant", "completion")]}, ("completion", "prompt")),
    "prompt-response": ({"fixed": [("system", "system"), ("user", "prompt"), ("assistant", "response")]}, ("prompt", "response")),
    "question-answer": ({"fixed": [("user", "question"), ("assistant", "answer")]}, ("answer", "question")),
    "nested-pair": ({"fixed": [("user", "prompt.text"), ("assistant", "response.text")]}, ("prompt.text", "response.text")),
}


def paths_of(record, at: str = "") -> set[str]:
    """The nested field paths of a JSON-like value; list items add [] and are taken together."""
    if isinstance(record, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in record.items())) if record else {at}
    if isinstance(record, (list, tuple)):
        return set().union(*(paths_of(v, f"{at}[]") for v in record)) if record else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(paths): (name, mapping, frozenset(paths)) for name, (mapping, paths) in LAYOUTS.items()}


def register(name: str, mapping: dict, paths) -> str:
    """Add a layout; returns its fingerprint."""
    REGISTRY[fp := fingerprint(paths)] = (name, mapping, frozenset(paths))
    return fp


def layout_of(paths: set[str], registry: dict) -> tuple[str, dict, frozenset] | None:
    """The layout for a record's paths; registry keeps what it finds under the paths' fingerprint."""
    fp = fingerprint(paths)
    if fp not in registry:
        has = lambda p: any(p == q or p.startswith((f"{q}.", f"{q}[]")) or (q.endswith("[]") and p.startswith(q)) for q in paths)
        fits = [x for x in registry.values() if x and all(map(has, x[2]))]
        registry[fp] = max(fits, key=lambda x: (len(x[2] & paths), len(x[2]), x[0]), default=None)
    return registry[fp]


def pick(record, path: str) -> str:
    """The text at a path; the parts of a list are joined."""
    if path == "":
        return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)
    if isinstance(record, list):
        return "".join(pick(x, path) for x in record)
    head, _, rest = path.partition(".")
    if head.endswith("[]"):
        return pick((record or {}).get(head[:-2]) or [], rest)
    return pick((record or {}).get(head), rest)


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    role = lambda r: ROLES.get(r.lower(), r)
    if "list" in mapping:
        return [(role(pick(x, mapping["role"])), pick(x, mapping["text"])) for x in record.get(mapping["list"]) or []]
    out = []
    for who, path in mapping["fixed"]:
        parts = [pick(record, p) for p in ((path,) if isinstance(path, str) else path)]
        text = "\n\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]
        if who.startswith("$"):
            out.append((pick(record, who[1:]), text))
        elif text or who != "system":
            out.append((who, text))
    return out


_TURNS = pa.schema([("id", pa.string()), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def turns_of_records(df: DataFrame, record: str = "record", key: str = "id", strict: bool = True) -> DataFrame:
    """JSON records of any registered layouts: (id, layout, turn, role, text), one row per turn. The id is the record's own
    where its layout has one."""
    given = dict(REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = dict(given)
        for b in batches:
            rows = []
            for k, raw in zip(b.column("id").to_pylist(), b.column("record").to_pylist(), strict=True):
                value = json.loads(raw) if raw else {}
                paths = paths_of(value)
                found = layout_of(paths, registry)
                if found is None:
                    if strict:
                        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
                    continue
                name, mapping, _ = found
                if "key" in mapping:
                    k = value.get(mapping["key"])
                for i, (r, t) in enumerate(canonical_turns(value, mapping)):
                    rows.append((None if k is None else str(k), name, value.get(mapping["order"]) if "order" in mapping else i, r, t))
            if rows:
                yield batch(_TURNS, *zip(*rows, strict=True))

    return arrow(df.select(F.col(key).cast("string").alias("id"), F.col(record).alias("record")), run, "id string, layout string, turn long, role string, text string")


def records_of_rows(df: DataFrame) -> DataFrame:
    """A typed table's rows as JSON records (id, record), nulls kept, of the columns that some layout names."""
    known = {p.split(".")[0].split("[")[0] for _, _, paths in REGISTRY.values() for p in paths}
    wanted = [c for c in df.columns if c in known]
    return df.select(F.lit(None).cast("string").alias("id"), F.to_json(F.struct(*wanted), {"ignoreNullFields": "false"}).alias("record"))


def conversations(records: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of records whose ids are numbers."""
    return turns_of_records(records).select(F.col("id").cast("long").alias("conv_id"), "turn", "role", "text")


# ---- template ------------------------------------------------------------------------------------------------


def escaped(text):
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2\3", text)


def formatted(turns: DataFrame) -> DataFrame:
    """Add `piece`, the turn as it stands in the formatted conversation: pieces in order make up the whole."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (before, after) in TEMPLATES.items():
        piece = F.when(F.col("role") == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(piece)
    return turns.withColumn("piece", piece)


_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def read_back(formatted_text: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and the span of the escaped text (the loss mask, if an assistant's)."""
    at, opens = 0, {v[0].strip(): (k, v) for k, v in TEMPLATES.items()}
    while at < len(formatted_text):
        m = _CONTROL.match(formatted_text, at)
        if not m:
            raise ValueError(f"no turn starts at character {at}")
        if m[0] in opens:
            role, (before, after) = opens[m[0]]
            start = at + len(before)
        else:
            end = _CONTROL.search(formatted_text, at + len(OTHER[0])).start() - 1
            role = unescape(formatted_text[at + len(OTHER[0]) : end])
            start, after = end + len(OTHER[1]), OTHER[2]
        stop = _CONTROL.search(formatted_text, start).start() - 1
        if formatted_text[stop : stop + len(after)] != after:
            raise ValueError(f"the turn at character {at} doesn't end")
        yield role, unescape(formatted_text[start:stop]), start, stop
        at = stop + len(after)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")])


def digests(pieces: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row each. Rows of a conversation stream by in order, so its length is no matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None

        def close():
            return (key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])

        for b in batches:
            rows = []
            for k, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if now is None or k != key:
                    if now is not None:
                        rows.append(close())
                    key, now = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_back(piece):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode())
                    if role == LOSS:
                        now[2] += len(text)
                        now[3].update(text.encode())
                now[4] += len(piece)
            if rows:
                yield batch(_DIGEST, *zip(*rows, strict=True))
        if now is not None:
            yield batch(_DIGEST, *([x] for x in close()))

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow(ordered.select("conv_id", "piece"), run, DIGEST)
