"""What the engine needs and whether it is there."""

from __future__ import annotations

import shutil
import subprocess
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CheckResult:
    name: str
    ok: bool
    details: str


def command_details(command: str) -> CheckResult:
    """Version of a program on the path, asked for in two ways."""
    if not shutil.which(command):
        return CheckResult(command, False, "not found")
    for flag in ("--version", "-version"):
        try:
            done = subprocess.run([command, flag], capture_output=True, text=True, timeout=5)
        except (OSError, subprocess.TimeoutExpired) as e:
            return CheckResult(command, False, str(e))
        if done.returncode == 0:
            return CheckResult(command, True, (done.stdout or done.stderr).strip().split("\n")[0])
    return CheckResult(command, False, "no version")


def module_details(module: str) -> CheckResult:
    try:
        m = __import__(module)
    except ImportError:
        return CheckResult(module, False, "not installed")
    return CheckResult(module, True, getattr(m, "__version__", "installed"))


def run_checks() -> list[CheckResult]:
    python = CheckResult("python", sys.version_info >= (3, 10), sys.version.split()[0])
    return [python, command_details("java"), module_details("pyspark"), module_details("pyarrow"), module_details("pypdf")]


def checks_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.name, c.ok, c.details) for c in run_checks()], "name string, ok boolean, details string")
