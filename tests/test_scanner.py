"""Source files made at random, with what they declare known from how they are made."""

import random

from mergetide.functions.scanner import DECLARED, declared, scanned

NAMES = [f.split(":")[0] for f in DECLARED.removeprefix("struct<").removesuffix(">").split(",")]
NOISE = ["", " ", "\n", " /* class No { constructor(x: No) {} } */ ", " // @Pipe({name: 'no'}) {\n", "\n/** it's `odd` */\n"]
VALUES = ["1", "f(g(h([1, {a: 2}])))", "'it\\'s, )'", "`x${y ? `)${z}` : '}'}`", "/[/)'\"]/g.test(q)", "(a, b) => { return a < b ? {a} : [b]; }", "new Map<string, A>()", "a / b / c"]


def expression(rng):
    return rng.choice(VALUES)


def array(rng):
    """Text of an array literal and the names that it lists."""
    parts, names = [], []
    for _ in range(rng.randrange(4)):
        name = f"N{rng.randrange(50)}"
        text, listed = rng.choice(
            [(name, True), (f"{name}.forRoot({expression(rng)}, x)", True), (f"{name}.part", True), (f"provide{name}({expression(rng)})", False), (f"...{name}", False), (f"{{ provide: {name}, useValue: {expression(rng)} }}", False), (f"a.{name}.b", False), (f"x ? {name} : y", False)]
        )
        parts.append(rng.choice(NOISE) + text)
        names += [name] if listed else []
    return "[" + ",".join(parts) + "]", names


def parameters(rng):
    texts, kinds = [], []
    for i in range(rng.randrange(4)):
        kind = rng.choice(["Foo", "string", "Store<A, B<C>>", "() => void", "ns.Bar", "{ a: X, b: Y }", "any", None])
        name = rng.choice([f"p{i}", f"p{i}?", "{ a, b }", "[c, d]"])
        text = rng.choice(["", "@Inject(TOKEN) ", "@Self() @Inject(f(g(1), [2])) "]) + rng.choice(["", "private ", "public readonly "]) + rng.choice(NOISE) + name
        text += f": {kind}" if kind else ""
        text += f" = {expression(rng)}" if not name.endswith("?") and rng.random() < 0.4 else ""
        texts.append(text)
        kinds += [kind] if kind and kind not in ("string", "any") else []
    return ", ".join(texts), kinds


def source(rng):
    want = {n: [] for n in NAMES if n in ("style_urls", "module_imports", "declarations", "exports", "providers", "component_providers", "injections")} | {n: None for n in ("kind", "class_name", "selector", "provided_in", "template", "template_url")}
    imports = [f"./i{i}" for i in range(rng.randrange(3))]
    exports = [f"./e{i}" for i in range(rng.randrange(3))]
    lines = [rng.choice([f"import {{ A, B as C }} from '{p}';", f"import '{p}'", f'import type D from "{p}";', f"import E, * as G from '{p}'"]) for p in imports]
    lines += [rng.choice([f"export * from '{p}';", f"export {{ x }} from '{p}'", f"export * as y from '{p}';"]) for p in exports]
    lines += ["export const text = `import z from './z'`;", f"function f() {{ const q = {expression(rng)}; class Inner {{}} }}", f"const r = {expression(rng)};"]
    rng.shuffle(lines)
    order = lambda ps: sorted(ps, key=lambda p: next(i for i, x in enumerate(lines) if f"'{p}'" in x or f'"{p}"' in x))
    want["imports"] = order(imports) + order(exports)
    first = None
    for c in range(rng.randrange(3)):
        name, kind = f"K{c}", rng.choice(["Component", "NgModule", "Injectable", "Directive", "Pipe", "Other"])
        first = first or name
        props, told = [f"other: {expression(rng)}", "'odd-key': 1"], {}
        if kind in ("Component", "Directive"):
            told["selector"] = f"app-{c}"
            props.append(f"selector: 'app-{c}'")
        if kind == "Pipe":
            told["selector"] = f"pipe{c}"
            props.append(f'"name": "pipe{c}"')
        if kind == "Injectable":
            props.append(f"providedIn: {rng.choice(['Mod', 'x()'])}" if rng.random() < 0.3 else "providedIn: 'root'")
            told["provided_in"] = "root" if props[-1].endswith("'root'") else None
        if kind == "Component":
            template, text = rng.choice([("`<a-b>:) @if (x) { }`", "<a-b>:) @if (x) { }"), ("'it\\'s'", "it's"), ("`${x}`", None)])
            props += [f"template: {template}", "styleUrls: ['./a.css', `./b.css`]"]
            told |= {"template": text, "style_urls": ["./a.css", "./b.css"]}
            text, told["component_providers"] = array(rng)
            props.append(f"providers: {text}")
        if kind == "NgModule":
            for field, column in (("imports", "module_imports"), ("declarations", "declarations"), ("exports", "exports"), ("providers", "providers")):
                text, told[column] = array(rng)
                props.append(f"{field}: {text}")
        rng.shuffle(props)
        text, kinds = parameters(rng)
        mark = f"@{kind}({{ " + ",".join(rng.choice(NOISE) + p for p in props) + " })"
        more = rng.choice(["", "@UntilDestroy() ", "@Odd([1]) "])
        head = rng.choice(["", " extends Base<{ a: 1 }>", " implements I, J<K>", " extends mix(A, B)"])
        body = f"a = {expression(rng)}; m(x: Y): Z {{ {expression(rng)}; }} constructor(u: Over); constructor({text}) {{ super({expression(rng)}); }} n() {{ return {expression(rng)}; }}"
        lines.append(rng.choice([mark + rng.choice(NOISE) + more, more + mark]) + rng.choice(["", "export ", "export default ", "export abstract "]) + f"class {name}{head} {{ {body} }}")
        if kind != "Other":
            want |= {k: v for k, v in told.items() if v is not None}
            want |= {"kind": {"Component": "component", "NgModule": "module", "Injectable": "service", "Directive": "directive", "Pipe": "pipe"}[kind], "class_name": name}
            want["injections"] = want["injections"] + (kinds if kind in ("Component", "Injectable", "Directive") else [])
    if want["kind"] is None:
        want["class_name"] = first
    return rng.choice(NOISE) + "\n".join(rng.choice(NOISE) + x for x in lines), want


def test_generated_files():
    rng = random.Random(11)
    for _ in range(2000):
        text, want = source(rng)
        assert declared(text) == want, text


def test_broken_files_end():
    for text in ("", "@", "@Component(", "class", "class A", "class A { constructor(", "import", "import {", "export * from", "`${", "'", "/*", "@Component({selector: 'x'", "constructor(a: B)", "}}}}", "const x = /", "\\", "x = '\\ud83d\\ude00'"):
        assert set(declared(text)) == set(NAMES)


def test_column(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "@Pipe({name: '\\ud83d\\ude00'}) class P {}")], "id long, text string").select("id", scanned("text").alias("s"))
    got = {r["id"]: r["s"] for r in rows.collect()}
    assert got[1]["kind"] is None and got[2]["imports"] == [] and (got[3]["kind"], got[3]["class_name"], got[3]["selector"]) == ("pipe", "P", "\U0001f600")
