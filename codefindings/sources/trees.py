"""Reading folder trees of any file system pyarrow knows (local, HDFS, S3, GCS).

Spark's own file listing leaves out every name starting with '.' or '_', among them ``.env`` and
``__init__.py``, so folders are listed and files are opened inside tasks instead. Ignored folders
are not descended into, and only files that survived the name and size tests are opened.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from codefindings.dims import names
from codefindings.functions import naming
from codefindings.sources.scratch import checkpointed

ENTRY = 'repo string, root string, path string, size bigint, problem string'
BATCH_ROWS = 5000
FOLDERS_PER_TASK = 500
BATCH_BYTES = 64 * names.MIB


def list_trees(roots: DataFrame, variant: str = 'repository', folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """repo, root, path (relative), filename and size of every file under the (repo, root) folders.

    What is not looked into has a row with a ``problem``: missing_root (path empty), linked_dir (a linked
    folder, which may lead back into the tree) or unreadable_dir. Ignored folders have none.

    The trees are listed in rounds. In each, the folders known but not listed yet are dealt to all tasks; a
    task lists up to ``folders_per_task`` of them and of what it finds in them and hands the rest back. So
    neither one huge tree, one wide folder nor one deep chain keeps a single task busy for long.
    Every round is checkpointed: no folder is listed twice, also after a lost executor.
    """
    ignored = set(names.IGNORED_DIRS_REPO if variant == 'repository' else names.IGNORED_DIRS)
    parts = int(roots.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    todo = roots.select('repo', 'root', F.lit('').alias('path'), F.lit(None).cast('bigint').alias('size'),
                        F.lit(None).cast('string').alias('problem'))
    found = []
    is_folder = F.col('size').isNull() & F.col('problem').isNull()
    while True:
        seen = checkpointed(todo.repartition(parts, 'repo', 'root', 'path').mapInPandas(_walker(ignored, folders_per_task), ENTRY))
        found.append(seen.filter(~is_folder))
        todo = seen.filter(is_folder)
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionAll, found).withColumn('filename', naming.basename(F.col('path')))


def _children(store: fs.FileSystem, folder: str) -> list[tuple[fs.FileInfo, bool]]:
    """What a folder holds, and whether it is a linked folder."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    local = isinstance(store, fs.LocalFileSystem)
    return [(i, local and i.type == fs.FileType.Directory and os.path.islink(i.path)) for i in found]


def _walker(ignored: set[str], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lists folders, nearest first; those beyond the first ``most`` are passed on as they are."""
    def walk(batches):
        rows, listed = [], 0
        for batch in batches:
            todo = deque((repo, root, path) for repo, root, path, *_ in batch.itertuples(index=False))
            while todo:
                repo, root, path = todo.popleft()
                if listed >= most:
                    rows.append((repo, root, path, None, None))
                    continue
                listed += 1
                store, base = fs.FileSystem.from_uri(root)
                if path == '' and store.get_file_info(base).type != fs.FileType.Directory:
                    rows.append((repo, root, '', None, 'missing_root'))
                    continue
                try:
                    held = _children(store, f'{base}/{path}'.rstrip('/'))
                except OSError:
                    rows.append((repo, root, path, None, 'unreadable_dir'))
                    continue
                for info, linked in held:
                    below = f'{path}/{info.base_name}'.lstrip('/')
                    if info.type == fs.FileType.File:
                        rows.append((repo, root, below, info.size, None))
                    elif info.type == fs.FileType.Directory and info.base_name.lower() not in ignored:
                        if linked:
                            rows.append((repo, root, below, None, 'linked_dir'))
                        else:
                            todo.append((repo, root, below))
                if len(rows) >= BATCH_ROWS:
                    yield _frame(rows)
                    rows = []
        yield _frame(rows)
    return walk


def _frame(rows) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=['repo', 'root', 'path', 'size', 'problem'])
    return frame.astype({'size': 'Int64'})


def with_contents(entries: DataFrame) -> DataFrame:
    """Add ``content`` (bytes) to listed files; NULL for a file that cannot be read.

    The narrow entries are spread by path first, then every task opens its files in batches of
    bounded size.
    """
    parts = int(entries.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    fields = ', '.join(f'{n} {t}' for n, t in entries.dtypes) + ', content binary'
    return entries.repartition(parts, 'repo', 'root', 'path').mapInPandas(_read, fields)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, contents, held = [], [], 0
        for i, root, path in zip(batch.index, batch['root'], batch['path']):
            store, base = fs.FileSystem.from_uri(root)
            try:
                with store.open_input_stream(f'{base}/{path}', compression=None) as stream:
                    data = stream.read()
            except OSError:
                data = None
            kept.append(i)
            contents.append(data)
            held += len(data or b'')
            if held >= BATCH_BYTES:
                yield batch.loc[kept].assign(content=contents)
                kept, contents, held = [], [], 0
        yield batch.loc[kept].assign(content=contents)
