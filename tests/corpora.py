"""Small hand-written repositories with known definitions, imports, calls and routes."""

TS_APP = {
    "src/app.ts": '''import express from 'express';
import { getUser } from './users/service';
import type { User } from "@/models/user";
import helper from 'util/helper';
import scoped from '@scope/pkg';
export * from './users';
const legacy = require('../old/legacy');

/* a block comment with { braces
   that stay open { */
export async function start(port: number) {
  const text = "a } in a string";
  if (port) { getUser(port); }
  return listen(port); // }
}

export const double = (x: number) => x * 2;

const build = (
  a: string,
  b: string,
) => {
  return helper(a, b);
};

export class UserService extends Base {
  private name = '{';
  constructor(private db: Db) {
    super();
  }
  find(id: string) {
    return this.db.query(`select ${id} {`);
  }
  save = async (user: User) => {
    await persist(user);
  };
}

export interface Shape {
  area(): number;
}

type Kind =
  | 'a'
  | 'b';

enum Color { Red, Green }

const UserModel = mongoose.model('User', schema);

app.get('/users/:id', auth, getUser);
router.post('/users', async (req, res) => {
  await create(req.body);
});
''',
    "src/users/service.ts": "export function getUser(id) {\n  return id;\n}\n",
    "src/users/index.ts": "export default function () {\n  return 1;\n}\n",
    "src/models/user.ts": "export interface User { id: string }\n",
    "src/util/helper.js": "module.exports.helper = function (a) {\n  return a;\n};\n",
    "old/legacy.js": "exports.run = () => {};\n",
    "src/Button.tsx": '''export function Button() {
  return <button onClick={() => go()}>x</button>;
}
export const Card = memo(() => <div />);
''',
    "app/api/(g)/users/route.ts": "export async function GET() {\n  return all();\n}\nexport function helper() {\n  return 2;\n}\n",
    "src/cats.controller.ts": '''@Controller('cats')
export class CatsController {
  @Get(':id')
  findOne(id: string) {
    return this.service.one(id);
  }
}
''',
}

PY_APP = {
    "app/main.py": '''import os, json as j
from . import views
from .pkg import tool as t
from ..core.db import (
    connect,
    close as shut,
)

router = APIRouter(prefix="/users")


@router.get("/{id}")
@cache(
    ttl=3,
)
def read_user(
    id: int,
):
    """Docs with def fake(): inside
def also_fake():
    """
    return load(id)


class User(BaseModel):
    name: str

    def full(self):
        return join(self.name)

    class Meta:
        def inner(self):
            return 1


@app.route("/login", methods=["POST"])
def _login():
    if x:
        def nested():
            pass
    return check(")")  # (
# trailing comment


def last(): return 1
''',
    "app/views.py": "def show():\n    return 1\n",
    "app/pkg/__init__.py": "",
    "app/pkg/tool.py": "X = 1\n",
    "core/db.py": "def connect():\n    pass\n",
    "a/util/same.py": "A = 1\n",
    "b/util/same.py": "B = 1\n",
    "app/user.py": "import util.same\nimport pkg.tool\n",
}

JAVA_APP = {
    "src/main/java/com/acme/UserController.java": '''package com.acme;

import com.acme.model.User;
import static com.acme.util.Tools.*;
import java.util.List;

@RestController
@RequestMapping("/api/users")
public class UserController {
    private final UserService service;

    public UserController(UserService service) {
        this.service = service;
    }

    @GetMapping("/{id}")
    public User find(@PathVariable Long id) {
        if (id == null) { throw new NotFound("{"); }
        return service.load(id);
    }

    static class Inner {
        void run() {
            go();
        }
    }
}
''',
    "src/main/java/com/acme/model/User.java": '''package com.acme.model;

@Entity
public class User {
    Long id;
}

interface Named {
    String name();
}

enum Role { ADMIN, USER }
''',
}

GO_APP = {
    "main.go": '''package main

import (
	"fmt"
	"example.org/acme/internal/store"
)

import "net/http"

type Server struct {
	name string
}

type Handler interface {
	Serve() error
}

type (
	ID int
	Item struct {
		id ID
	}
)

func (s *Server) Start(addr string) error {
	fmt.Println("{")
	return listen(addr)
}

func main() {
	r.GET("/items", listItems)
	http.HandleFunc("/health", func(w http.ResponseWriter, q *http.Request) {
		write(w)
	})
}
''',
    "internal/store/store.go": "package store\n\nfunc Open() {\n}\n",
    "internal/store/store_test.go": "package store\n\nfunc TestOpen() {\n}\n",
}

CORPORA = {"ts": TS_APP, "py": PY_APP, "java": JAVA_APP, "go": GO_APP}


def raw_files(spark):
    rows = [(repo, path, text) for repo, files in CORPORA.items() for path, text in files.items()]
    return spark.createDataFrame(rows, "repository_id string, path string, content string")
