"""A small project of several languages."""

FILES = {
    "models.py": '''class User:
    name: str
    email: str

    def __init__(self, name, email):
        self.name = name
        self.email = email

    def check_name(self):
        return bool(self.name)

    def check_email(self):
        return "@" in self.email

    def validate(self):
        return self.check_name() and self.check_email()

    def get_display_name(self):
        return self.name


class Product:
    title: str
    price: float
    stock: int

    def __init__(self, title):
        self.title = title

    def total(self, n: int = 1, *args, **kw) -> float:
        return self.price * n
''',
    "utils.py": '''def format_currency(value):
    return f"{value:.2f}"


def shout(text):
    return text.upper()


def summarize(items):
    return [format_currency(i) for i in items]
''',
    "services/user_service.py": '''from models import User
from utils import format_currency


class UserService:
    def create_user(self, name):
        return User(name, "x")

    def get_display(self, user):
        return user.get_display_name()

    def validate_user(self, user):
        return user.validate()

    def format_price(self, v):
        return format_currency(v)
''',
    "main.py": '''import models as m
from services.user_service import UserService as US

service = US()


def run(user):
    m.User("a", "b")
    return service.get_display(user)
''',
}

JAVA = {
    "com/x/Base.java": "package com.x;\npublic class Base { public int go(int a) { return a; } }\n",
    "com/x/A.java": """package com.x;
import java.util.List;
import com.x.Base;
/* c { */
@Ann(a = {1, 2})
public class A<T extends B> extends Base implements I<T>, K {
    private final Map<String, List<Integer>> items = new HashMap<>() {{ put("}", null); }}; // hi
    int n = 3, k;
    public A(int x) { this.n = x; helper(x); }
    @Override
    public <R> List<R> run(final int a, java.util.List<String> names) throws E { Base b = new Base(1); return b.go(a); }
    private void helper(int q) {}
    static class Inner { void z() {} }
    enum Q { A, B; void m() {} }
}
""",
}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
