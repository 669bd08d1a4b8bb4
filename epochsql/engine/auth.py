"""Users, roles by database, and what each role may do."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import SparkSession

from ..sources.files import Files

ROLES = ("SUPERADMIN", "ADMIN", "NORMAL", "READONLY", "DENIED")
READS = {"SELECT", "EXPLAIN", "ANALYZE"}
SHOWS = {"SHOW", "DESCRIBE", "WHOAMI", "LOGIN", "USE", "PRAGMA"}
DML = READS | {"INSERT", "UPDATE", "DELETE", "TRUNCATE", "BEGIN", "COMMIT", "ROLLBACK"}
DDL = {"CREATE DATABASE", "DROP DATABASE", "CREATE TABLE", "DROP TABLE", "CREATE INDEX", "DROP INDEX", "ALTER TABLE", "CREATE VIEW", "DROP VIEW", "VACUUM", "CHECKPOINT", "RECOVER"}
ALLOWED = {"ADMIN": DML | DDL | SHOWS, "NORMAL": DML | SHOWS, "READONLY": READS | SHOWS, "DENIED": {"LOGIN", "WHOAMI", "USE"}}
ROOT = "root"


class AuthError(PermissionError):
    pass


def allowed(role: str, action: str) -> bool:
    return role == "SUPERADMIN" or action in ALLOWED[role]


def _digest(password: str, salt: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), 100_000).hex()


class Users:
    """Kept in <root>/users.json. The first user is root, a SUPERADMIN who can't be changed or dropped."""

    def __init__(self, spark: SparkSession, root: str, root_password: str = "root"):
        self.files, self.path = Files(spark), f"{root}/users.json"
        if not self.files.exists(self.path):
            self._save({ROOT: self._entry(root_password, {"*": "SUPERADMIN"})})

    def _entry(self, password: str, roles: dict[str, str]) -> dict:
        salt = os.urandom(16).hex()
        return {"salt": salt, "hash": _digest(password, salt), "roles": roles}

    def all(self) -> dict[str, dict]:
        return self.files.read(self.path)

    def _save(self, users: dict) -> None:
        self.files.write(self.path, users)

    def login(self, name: str, password: str) -> bool:
        u = self.all().get(name)
        return bool(u) and hmac.compare_digest(u["hash"], _digest(password, u["salt"]))

    def role(self, name: str, db: str) -> str:
        roles = self.all().get(name, {}).get("roles", {})
        return roles.get("*") if roles.get("*") == "SUPERADMIN" else roles.get(db, "DENIED")

    def create(self, name: str, password: str, role: str, db: str) -> None:
        users = self.all()
        if name in users:
            raise AuthError(f"User already exists: {name}")
        users[name] = self._entry(password, {"*" if role == "SUPERADMIN" else db: role})
        self._save(users)

    def alter(self, name: str, role: str, db: str) -> None:
        users = self.all()
        if name == ROOT or name not in users:
            raise AuthError(f"User can't be changed: {name}")
        users[name]["roles"]["*" if role == "SUPERADMIN" else db] = role
        if role != "SUPERADMIN":
            users[name]["roles"].pop("*", None)
        self._save(users)

    def drop(self, name: str) -> None:
        users = self.all()
        if name == ROOT or name not in users:
            raise AuthError(f"User can't be dropped: {name}")
        del users[name]
        self._save(users)
