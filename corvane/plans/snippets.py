"""A small repository of program code, as the driver's tables hold none."""

LONG = "def long_one(x):\n" + "\n".join(f"    if x > {i}:\n        x += {i}" for i in range(65)) + "\n    return x\n"
WIDE = "class Wide:\n" + "\n".join(f"    def m{i}(self):\n        return {i}" for i in range(11)) + "\n"
BUGS = '''import pickle

def chained(d):
    return d.get("k").strip()

def optional(p=None):
    return p.name

def share(total, count):
    return total / count

def forever():
    while True:
        pass

def none():
    return None.x

def leak(name):
    f = open(name)
    return f
'''
SECURITY = '''import hashlib, os, pickle, requests, subprocess

DEBUG = True
API_KEY = "k8Jq2mZx91LpQw7v"

def run(cur, request, user_url):
    cur.execute("select " + request.args["q"])
    open(request.args["path"])
    requests.get(user_url)
    pickle.loads(request.data)
    subprocess.run("ls", shell=True)
    os.system("rm " + "x")
    return hashlib.md5(b"x")
'''
HUB = "\n".join(f"import part{i}" for i in range(10)) + "\n"
DESIGN = '''class Service:
    def __init__(self):
        self.store = Store()

def pick(x):
    if isinstance(x, int):
        return 1
    if isinstance(x, str):
        return 2
    if isinstance(x, list):
        return 3
'''
JAVA = '''import java.util.List;

public class Box extends Base implements Thing {
    private int n;
    public int size(int a, String b) {
        return n;
    }
}
'''
TYPESCRIPT = '''import { a } from 'lib/a';
export interface Shape extends Base { area: number }
export class Square extends Shape {
}
export const twice = (x) => x * 2;
'''
CPP = '''#include <vector>
#include "shape.h"
class Circle : public Shape {
  int r;
};
int area(int r) {
  return r * r;
}
'''
FILES = [
    ("app/alpha.py", "python", "import beta\n\ndef a():\n    return 1\n"),
    ("app/beta.py", "python", "import alpha\n\ndef b():\n    return 2\n"),
    ("app/hub.py", "python", HUB),
    *((f"app/part{i}.py", "python", f"X = {i}\n") for i in range(10)),
    ("model/user.py", "python", "import endpoint\n"),
    ("web/endpoint.py", "python", "Y = 1\n"),
    ("app/bugs.py", "python", BUGS),
    ("app/security.py", "python", SECURITY),
    ("app/long.py", "python", LONG),
    ("app/wide.py", "python", WIDE),
    ("app/design.py", "python", DESIGN),
    ("tests/test_bugs.py", "python", BUGS),
    ("app/broken.py", "python", "def f(:\n"),
    ("app/empty.py", "python", ""),
    ("app/Box.java", "java", JAVA),
    ("app/shape.ts", "typescript", TYPESCRIPT),
    ("app/circle.cpp", "cpp", CPP),
]


def files(spark):
    """source_file rows of the repository."""
    return spark.createDataFrame([("mini", p, lang, c) for p, lang, c in FILES], "repo_id string, file_path string, language string, content string")
