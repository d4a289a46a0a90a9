"""Row-at-a-time resolution of references, for comparison on small tables."""

import bisect
from collections import defaultdict


def brute_orphans(relationships, files, symbols, modules, external):
    """Sets of (rel_id, field); arguments are lists of dicts."""
    born, died = {}, {}
    for f in files:
        k = (f["repo"], f["path"])
        born[k] = min(born.get(k, f["last_indexed"]), f["last_indexed"])
        if f["deleted_at"] is not None:
            died[k] = f["deleted_at"]
    sb, sd, names = {}, {}, defaultdict(set)
    for s in symbols:
        i = s["symbol_id"]
        sb[i] = min(sb.get(i, s["indexed_at"]), s["indexed_at"])
        if s["deleted_at"] is not None:
            sd[i] = s["deleted_at"]
        names[s["repo"], False, s["symbol_name"]].add(i)
        if s["parent"] is not None:
            names[s["repo"], True, f"{s['parent']}.{s['symbol_name']}"].add(i)
    mods = {(m["repo"], m["path"]) for m in modules}
    pack = {e["target_ref"] for e in external if e["target_kind"] == "package"}
    call = {e["target_ref"] for e in external if e["target_kind"] == "callable"}

    def file_at(repo, path, t):
        k = (repo, path)
        return k in born and born[k] <= t and (k not in died or died[k] > t)

    def symbol_at(repo, dotted, name, t):
        return any(sb[i] <= t and (i not in sd or sd[i] > t) for i in names.get((repo, dotted, name), ()))

    def climb(base, n):
        return base[: len(base) - n] if n <= len(base) else None

    out = set()
    for r in relationships:
        repo, t, rid = r["repo"], r["indexed_at"], r["rel_id"]
        seg = [x for x in (r["source_file"] or "").replace("\\", "/").split("/") if x not in ("", ".")]
        src = "/".join(seg)
        if r["source_file"] is not None and not file_at(repo, src, t):
            out.add((rid, "source_file"))
        n = r["target_name"]
        if n is not None and n.split(".")[0] not in ("self", "cls", "this") and n not in call and not symbol_at(repo, "." in n, n, t):
            out.add((rid, "target_name"))
        p = r["target_path"]
        if p is None:
            continue
        if src.endswith(".py"):
            dots = len(p) - len(p.lstrip("."))
            rest = [x for x in p.lstrip(".").split(".") if x]
            base = climb(seg[:-1], dots - 1) if dots else []
            ok = not dots and p.split(".")[0] in pack
            if not ok and base is not None:
                full = base + rest
                ok = (repo, ".".join(full)) in mods or file_at(repo, "/".join(full) + ".py", t) or file_at(repo, "/".join([*full, "__init__.py"]), t)
        elif p.startswith("."):
            at = seg[:-1] if r["source_file"] is not None else None
            for x in p.split("/"):
                if at is None:
                    break
                if x == "..":
                    at = climb(at, 1)
                elif x not in ("", "."):
                    at = [*at, x]
            ok = at is not None and any(file_at(repo, "/".join(at) + e, t) for e in ("", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts"))
        else:
            ok = "/".join(p.split("/")[: 2 if p.startswith("@") else 1]) in pack
        if not ok:
            out.add((rid, "target_path"))
    return out
