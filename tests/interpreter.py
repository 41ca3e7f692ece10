"""A sequential replay of a log, op by op: the second opinion on the resolver."""

from strandlog.functions.ids import RELATION_ENTITY_PREFIX, uuid8


def replay(ops):
    """ops: dicts in order with op_type, id, set [(property, language, value)], unset [(property, mode, language)], fields."""
    kind, dead, slots, rel, slot_ref = {}, set(), {}, {}, {}
    for op in ops:
        t, i = op["op_type"], op["id"]
        want = "E" if t <= 4 else "R" if t <= 8 else "V"
        if t in (1, 5, 9):
            fresh = i not in kind
            if not fresh and (kind[i] != want or t == 5):
                continue
            kind[i] = want
            if t == 5:
                rel[i] = {"position": op.get("position"), "from": op["from"], "to": op["to"]}
                kind.setdefault(op.get("entity") or uuid8(RELATION_ENTITY_PREFIX.encode() + i), "E")
            if t == 9:
                slot_ref[op["slot"]] = i
        elif kind.get(i) != want:
            continue
        if t in (3, 7):
            dead.add(i)
        elif t in (4, 8):
            dead.discard(i)
        elif i in dead:
            continue
        if t in (1, 2):
            for p, mode, lang in op.get("unset", ()):
                for key in [k for k in slots if k[0] == i and k[1] == p and (mode == 0 or k[2] == (lang if mode == 2 else None))]:
                    del slots[key]
            for p, lang, v in op.get("set", ()):
                slots[i, p, lang] = v
        if t == 6:
            if op.get("unset_position"):
                rel[i]["position"] = None
            if op.get("position") is not None:
                rel[i]["position"] = op["position"]
    refs = {}
    order = {op["slot"]: n for n, op in enumerate(ops) if op["op_type"] == 9 and kind.get(op["id"]) == "V"}
    for slot, n in sorted(order.items(), key=lambda x: x[1]):
        refs[slot_ref[slot]] = slot
    return kind, dead, slots, rel, refs
