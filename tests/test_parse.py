import pytest

from kinfold.operators import parse, styles


def names(source, path="/s/thing.tsx", **options):
    return [r["name"] for r in parse.parse_source(path, source, **options)]


def only(source, path="/s/thing.tsx", **options):
    (r,) = parse.parse_source(path, source, **options)
    return r


def test_ignore_marks():
    assert names(f"// {parse.IGNORE_FILE}\nfunction A() {{ return <a/> }}") == []
    source = f"// {parse.IGNORE_NEXT}\nfunction A() {{ return <a/> }}\n\n\nfunction B() {{ return <b/> }}"
    assert names(source) == ["B"] and names(source, allow_ignores=False) == ["A", "B"]


def test_named_function_expression_with_rest_prop():
    r = only('const Card = function Inner({ title, ...rest }) { api.fetchAll(1); const n = 3; return <Foo.Bar x="1">{title}</Foo.Bar>; };')
    assert r["name"] == "Card" and r["props"] == {"names": ["title"], "spreads": 1}
    assert "fetchAll" in r["logic"] and r["logic"][0] == "Inner" and "3" in r["literals"] and r["refs"] == ["Foo"] and r["tags"] == ["Bar"]
    assert r["literals"].count("1") == 2  # as an attribute and as a literal, but not inside the call


def test_call_arguments_are_entered_only_on_request():
    source = "function List({ items }) { return <ul>{items.map((i) => <li>{'x'}</li>)}</ul>; }"
    assert only(source)["tags"] == ["ul"] and only(source, descend_calls=True)["tags"] == ["ul", "li"]


def test_attributes():
    r = only("function A(props) { return <B icon={Icons.Add} make={factory().Thing} className='x  y' {...props} on />; }")
    assert r["refs"] == ["B", "Icons"] and r["classes"] == ["x", "y"] and r["literals"].count("spread") == 1 and r["props"]["names"] == ["props"]


def test_what_is_not_a_component():
    assert names("class thing extends Component {}") == [] and names("class A {}") == [] and names("class A extends factory() {}") == []
    assert names("const x = () => <a/>; const Y = memo(() => <b/>);") == []
    assert names("class A extends React.PureComponent { render() { return <div/>; } }") == ["A"]


def test_parameters():
    assert only("const A = ({ a: b, c = 1, 'd': e }) => <i/>;")["props"]["names"] == ["a", "c", "d"]
    assert only("const A = ([x]) => <i/>;")["props"] == {"names": [], "spreads": 0}
    assert only("class A extends Component { render() { return <i/> } }")["props"]["names"] == []


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("export default function widget() { return <a/>; }", ["widget"]),
        ("export default () => <a/>;", ["thing"]),
        ("export default class extends Component { render() { return <a/>; } }", ["thing"]),
        ("export default 42;", []),
        ("export async function Deep() { const Inner = () => <b/>; return <a/>; }", ["Deep", "Inner"]),
    ],
)
def test_names(source, wanted):
    assert names(source) == wanted


def test_nested_in_an_ignored_one():
    assert names(f"// {parse.IGNORE_NEXT}\nfunction A() {{\n\n\n const B = () => <b/>;\n return <a/>; }}") == ["B"]


def test_paths_texts_and_hooks():
    r = only("function A() { const [a] = useState(0); if (a) { useThing(); } return <main><p> hi <b>you</b></p><svg:path/></main>; }")
    assert r["paths"] == ["main", "main>p", "main>p>b", "main>Unknown"] and r["texts"] == ["hi", "you"] and r["hooks"] == ["useState", "useThing"]
    assert r["returns_count"] == 4 and r["tags"][-1] == "Unknown"


def test_dialects_and_hard_tokens():
    assert names("export const A = <T,>(x: T) => { return x < 1 ? 2 : 3; }", "/s/a.ts") == ["A"]
    assert names("@dec class A extends Component { x = /[/]>/g.test('a') ? `t${1}` : 2; render() { return <a b=\"'\">it's</a>; } }", "/s/a.js") == ["A"]
    with pytest.raises(parse.Broken):
        parse.parse_source("/s/a.tsx", "function A() { return <a><b></a>; }")


def test_places_and_style_imports():
    r = only("import x from './a/b.css';\nimport '../c.scss';\nimport y from 'z';\n  function A() { return <a/>; }")
    assert r["loc"]["start"] == {"line": 4, "column": 2} and r["source"].startswith("function A") and r["style_imports"] == ["/s/a/b.css", "/c.scss"]


def test_rows_and_errors(spark):
    files = spark.createDataFrame([("/a.tsx", "const Btn = ({ x }) => <b>{x}</b>;"), ("/b.tsx", "const A = ("), ("/c.tsx", None)], "path string, source string")
    rows = parse.parse_files(files).collect()
    assert [(r["id"], r["wrapper"]) for r in rows] == [("/a.tsx#Btn", True)]
    assert [r["path"] for r in parse.parse_files(files, errors=True).collect()] == ["/b.tsx"]


def test_css_rules():
    css = ".a, .b { x: 1 } .ab { y: 2 } @media z { .a:hover { q: 3 } } .c"
    assert styles.used_rules(css, ["a", "b"]) == ".a, .b { x: 1 }\n\n@media z { .a:hover { q: 3 }"
    assert styles.used_rules(css, ["AB"]) == ".ab { y: 2 }" and styles.used_rules(css, ["c"]) == "" and styles.used_rules(".a { x", ["a"]) == ""
    assert styles.merged([(5, 6), (0, 2), (3, 4)]) == [(0, 6)]


def test_styles_of_components(spark):
    source = "import './x.css'; const A = () => <a className='one'>{css`p{}`}</a>; const B = () => <b/>;"
    found = parse.parse_files(spark.createDataFrame([("/s/a.tsx", source)], "path string, source string"))
    sheets = spark.createDataFrame([("/s/x.css", ".one { k: v } .two {}")], "path string, source string")
    rows = {r["name"]: r for r in styles.load_styles(found, sheets).collect()}
    assert rows["A"]["style_text"] == "p{}\n.one { k: v }" and rows["A"]["css_in_js"] and rows["A"]["style_paths"] == ["/s/x.css"]
    assert rows["B"]["style_text"] == "" and not rows["B"]["has_styles"]
