"""Mines for tests: one of each artifact, and one of many cards."""

import hashlib
import os

from plumbline.core import state as S


def put(root, path, text):
    place = os.path.join(root, path)
    os.makedirs(os.path.dirname(place), exist_ok=True)
    with open(place, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return place


def get(root, path):
    with open(os.path.join(root, path), "rb") as f:
        return f.read().decode()


def edit(root, path, old, new):
    text = get(root, path)
    assert old in text, (path, old)
    put(root, path, text.replace(old, new, 1))


PROJECT = "---\nversion: 3\nlanguage: en\nroles: [contract, minutes]\ntone: plain\nrequired_tags: []\n---\nA project.\n"
CONFIG = "version: 3\npaths:\n  inbox: inbox\n  materials: materials\n  truths: truths\n  documents: documents\nfidelity:\n  completeness: off\ngaps:\n  markers: TBD|TODO\n"
REVIEW = "---\nround: 1\nconsecutive_passes: 1\n{}---\n# Review\n\n## Fidelity violations\n\n- [{{kind}}] {{what}}\n\n## Findings\n\nReads well.\n\n## Adjudications\n\nNothing to decide yet.\n\n## Human queue\n\n- [ruled] [user-only] naming 🙂\n"


def material(n, body, **more):
    fields = {"id": f"m{n:03}", "title": f"Agreement {n}", "origin": "file", "role": "contract", "topics": "[rent]", "format": "md", "source_path": "source.md", "added": "2026-02-01", "status": "used", "summary": "what it says"} | more
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + "---\n" + body


def truth(n, quote, **more):
    fields = {"id": f"t{n:03}", "claim": f"claim {n}", "source": "m001", "location": "§1", "tags": "[rent]", "provenance": "stated"} | more
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + "---\n" + quote + "\n"


def index_line(n, claim=None, source="m001", tags="rent"):
    return f"- t{n:03}: {claim or f'claim {n}'} [{source}] — [{tags}]\n"


def pristine(root):
    """One material, one truth, one document that has been promoted."""
    body = "The rent is 900 a month — naïve as it sounds.\nIt falls due on the third.\nNotice is three months.\n"
    put(root, "project.md", PROJECT)
    put(root, "config.yaml", CONFIG)
    put(root, "conflicts.json", S.write_conflicts([]))
    put(root, "id-sequences.json", S.write_sequences({"conflict": 1, "material": 2, "truth": 2}))
    put(root, "catalog.md", "| id | title | role | status |\n|---|---|---|---|\n| m001 | Agreement 1 | contract | used |\n")
    put(root, "materials/m001/source.md", body)
    put(root, "materials/m001/converted.md", material(1, body))
    put(root, "truths/t001.md", truth(1, "The rent is 900 a month — naïve as it sounds.\nIt falls due on the third."))
    put(root, "truths/index.md", index_line(1))
    put(root, "truths/tree.md", "## rent\n\n- t001: claim 1\n\n")
    put(root, "truths/coverage.md", "# Coverage\n\n## m001\n\n- rent: t001\n- notice: skipped, not asked for\n")
    put(root, "truths/verify.md", "---\nstatus: open\nround: 1\n---\n## Verified units\n\n## Adjudications\n\n## Human queue\n")
    put(root, "documents/d1/plan.md", "---\ndoc_id: d1\ndoc_type: memo\ntone: plain\nstatus: done\ncontinues: []\ncited_truths: [t1]\nscope_tags: [rent]\n---\n# Outline\n")
    text = "# Memo\n\nThe rent is 900. <!-- t:t001 -->\n"
    put(root, "documents/d1/draft.md", text)
    put(root, "documents/d1/final.md", text)
    put(root, "documents/d1/review.md", REVIEW.format("review_legacy: 2026-01-05\n"))
    os.makedirs(os.path.join(root, "inbox"), exist_ok=True)
    copy = hashlib.sha256(get(root, "materials/m001/converted.md").replace("status: used\n", "").encode()).hexdigest()
    name = hashlib.sha256(f"source.md\0{hashlib.sha256(body.encode()).hexdigest()}\n".encode()).hexdigest()
    put(root, "materials/intake-ledger.tsv", "# id\tsource digest\tword\tsources\tcopy digest\tnote\tdate\n" + "\t".join(["m001", name, "declared", "1", copy, "-", "2026-02-01"]) + "\n")
    return root


def scale(root, materials=8, truths=60):
    """Many cards, no documents; truth i quotes a line of material (i - 1) mod 8 + 1."""
    pristine(root)
    import shutil

    shutil.rmtree(os.path.join(root, "documents"))
    os.makedirs(os.path.join(root, "documents"))
    bodies = {m: [f"Clause {k} of agreement {m} says {k * m} things." for k in range(1, 41)] for m in range(1, materials + 1)}
    for m, lines in bodies.items():
        put(root, f"materials/m{m:03}/source.md", "\n".join(lines) + "\n")
        put(root, f"materials/m{m:03}/converted.md", material(m, "\n".join(lines) + "\n"))
    index, coverage = "", {m: "" for m in bodies}
    for i in range(1, truths + 1):
        m, k = (i - 1) % materials + 1, (i - 1) // materials + 1
        put(root, f"truths/t{i:03}.md", truth(i, bodies[m][k - 1], source=f"m{m:03}", tags=f"[scale, clause{k}]"))
        index += index_line(i, source=f"m{m:03}", tags=f"scale, clause{k}")
        coverage[m] += f"- clause {k}: t{i:03}\n"
    put(root, "truths/index.md", index)
    put(root, "truths/coverage.md", "".join(f"## m{m:03}\n\n{c}\n" for m, c in coverage.items()))
    put(root, "catalog.md", "| id | title | role | status |\n|---|---|---|---|\n" + "".join(f"| m{m:03} | Agreement {m} | contract | used |\n" for m in bodies))
    put(root, "id-sequences.json", S.write_sequences({"conflict": 1, "material": materials + 1, "truth": truths + 1}))
    return root
