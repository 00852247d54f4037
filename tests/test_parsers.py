"""Source scanners alone, without Spark: what must be found in a text, and what must not."""

from graphloom.operators.extract import python_nodes
from graphloom.operators.java import _calls, java_nodes


def uids(parse, path, text):
    return [r["uid"] for r in parse(path, text.encode())]


BROKEN = '''DOC = """
class Fake:
    def no(self): pass
x = 1
"""


class Real:
    """of a class
class Other:
    """
    def ok(self):
        text = \'\'\'
def fake2(): pass
\'\'\'
        return text

    def broken(self:
        return 1

    def fine(self):
        return f(
a=1,
b="class Q:",
)


def bad(:
    pass

TABLE = {
 "a": 1,
"b": [
2,
]}

def good():
    # """ opens nothing
    return 1
'''


def test_no_nodes_from_strings_or_brackets():
    assert uids(python_nodes, "a.py", BROKEN) == ["a.py", "a.py#DOC", "a.py#Real", "a.py#Real.ok(...)", "a.py#Real.fine(...)", "a.py#TABLE", "a.py#good(...)"]
    assert uids(python_nodes, "a.py", 'def f(:\n  pass\nx = """never closed\nclass A:\n  pass\n') == ["a.py", "a.py#A"]
    assert uids(python_nodes, "a.py", "x = (1,\ndef g():\n    return 1\n\n\ndef h(:\n    pass\n") == ["a.py", "a.py#g(...)"]


def test_java_calls_have_no_limits():
    calls = _calls("{ g(" + " " * 5000 + "x); new" + " " * 100 + "Foo(1); renew Foo(2); h(" + " " * 9000 + "); }")
    assert [(c["name"], c["arity"], c["is_creation"]) for c in calls] == [("g", 1, False), ("Foo", 1, True), ("Foo", 1, False), ("h", 0, False)]


JAVA = """package a;
@Component("x y") /* c */
public abstract class DataProcessor<T> extends Base<T> implements I {
  @Serialized /* This one goes */ public static final double TAU = 6.28; // note
  private List<String> activeUsers, more;
  int arr[] = {1,2};
  @Override
  public static <T> List<T> processData(final int a, @NonNull java.lang.String b) throws E { return null; }
  void ping() {}
  void v(int a, String... rest) {}
  void longer(Map<String, Map<String, List<Map<Integer, java.util.Set<String>>>>> m, int q[]) {}
  Map<String,Integer>m(List<String>x) { return x; }
}
"""


def test_java_signatures():
    got = {r["uid"].partition("#")[2]: r.get("signature") for r in java_nodes("D.java", JAVA.encode())}
    own = "DataProcessor"
    assert got == {
        "": None,
        own: '@Component("x y") public abstract class DataProcessor<T>',
        f"{own}.TAU": "@Serialized public static final double TAU",
        f"{own}.activeUsers": "private List<String> activeUsers",
        f"{own}.arr": "int arr",
        f"{own}.processData(int, String)": "@Override public static <T> List<T> processData(int, java.lang.String)",
        f"{own}.ping()": "void ping()",
        f"{own}.v(int)": "void v(int)",
        f"{own}.longer(Map, int)": "void longer(Map<String, Map<String, List<Map<Integer, java...., int)",
        f"{own}.m(List)": "Map<String,Integer> m(List<String>)",
    }


def test_java_members_in_linear_time():
    import time

    def seconds(n):
        text = "class A {\n" + "\n".join(f"void m{i}(int a) {{ b(a); }}" for i in range(n)) + "}"
        began = time.process_time()
        assert len(list(java_nodes("x.java", text.encode()))) == n + 2
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 10 * max(seconds(4_000), 0.05)
