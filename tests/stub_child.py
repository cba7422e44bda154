"""A stand-in for a model: marks capitalised words, and fails as its arguments say (in a folder that counts over restarts)."""

import json
import os
import re
import sys
import time

folder, crash, hang, junk = sys.argv[1], *map(int, sys.argv[2:5])


def count(what):
    n = 0
    while True:
        try:
            os.close(os.open(os.path.join(folder, f"{what}-{n}"), os.O_CREAT | os.O_EXCL))
            return n
        except FileExistsError:
            n += 1


def say(x):
    print(json.dumps(x), flush=True)


count("start")
say({"ok": True, "evento": "arrancado"})
loaded = False
for line in sys.stdin:
    ask = json.loads(line)
    if ask["op"] == "salir":
        say({"ok": True, "evento": "fin"})
        break
    if ask["op"] == "cargar":
        loaded = ask.get("gliner") == "stub"
        say({"ok": True, "evento": "listo"} if loaded else {"ok": False, "error": "no such model"})
    elif ask["op"] == "disponibles":
        say({"ok": True, "spacy": ["es"]})
    elif ask["op"] == "procesar":
        if any("REFUSE" in p for p in ask["parrafos"]):
            say({"ok": False, "id": ask["id"], "error": "refused text"})
            continue
        n = count("ask")
        if crash and n % crash == crash - 1:
            sys.exit(3)
        if hang and n % hang == hang - 1:
            time.sleep(60)
        if junk and n % junk == junk - 1:
            print("}not json", flush=True)
            continue
        if any("POISON" in p for p in ask["parrafos"]):
            sys.exit(4)
        ents = [[{"inicio": m.start(), "fin": m.end(), "texto": m[0], "etiqueta": "persona", "score": 0.9} for m in re.finditer(r"[A-Z]\w+", p)] for p in ask["parrafos"]]
        rels = [[{"a": e[0]["texto"], "b": e[1]["texto"], "predicado": ask["predicado"], "score": 0.7}] if len(e) > 1 else [] for e in ents]
        say({"ok": True, "id": ask["id"], "parrafos": ents, "relaciones": rels, "ms": 1})
