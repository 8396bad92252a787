import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from srcatlas.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    s = local_session(4, partitions=4, memory="3g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def kotlin_project(tmp_path):
    """Two build modules, base classes, markers, features and directories that must be pruned."""

    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("build.gradle.kts", "plugins {}\n")
    put("features/favorites/presentation/build.gradle.kts", 'dependencies {\n  implementation(project(":core"))\n  api("com.x:y:1")\n}\n')
    put("core/build.gradle", "implementation 'a:b:1'\n")
    put("core/src/main/kotlin/com/app/core/BaseViewModel.kt", "package com.app.core\n\nabstract class BaseViewModel : Root() {\n    fun load() {}\n}\n")
    put("core/src/main/kotlin/com/app/core/Root.kt", "package com.app.core\n\nopen class Root\n")
    put("core/src/main/kotlin/com/app/core/Marker.kt", "package com.app.core\n\ninterface Marker\n")
    for k in range(6):
        base = f"features/favorites/presentation/src/main/kotlin/com/app/f{k}"
        put(f"{base}/F{k}ViewModel.kt", f"package com.app.f{k}\n\nimport com.app.core.BaseViewModel\nimport com.app.core.*\n\nclass F{k}ViewModel : BaseViewModel(), Marker {{\n    fun a() {{}}\n}}\n")
        put(f"{base}/F{k}Screen.kt", f"package com.app.f{k}\n\nfun F{k}Screen() {{\n}}\n")
    put("features/favorites/presentation/src/main/kotlin/com/app/f0/F0Repository.kt", "package com.app.f0\n\nclass F0Repository\n")
    put("build/Gen.kt", "class Gen\n")
    put("_x/Kept.kt", "class Kept\n")
    put(".y/AlsoKept.kt", "class AlsoKept\n")
    put("node_modules/No.kt", "class No\n")
    return tmp_path
