"""Language lookup tables: file extension or file name -> language."""

# Extension -> language of the full table (one final value per extension).
FULL_EXTENSIONS = {
    '.py': 'python', '.pyx': 'python', '.pyw': 'python', '.pyi': 'python',
    '.js': 'javascript', '.jsx': 'javascript', '.mjs': 'javascript', '.cjs': 'javascript',
    '.ts': 'typescript', '.tsx': 'typescript',
    '.java': 'java', '.jsp': 'java', '.jspx': 'java',
    '.kt': 'kotlin', '.kts': 'kotlin', '.scala': 'scala', '.sc': 'scala',
    '.clj': 'clojure', '.cljs': 'clojure', '.groovy': 'groovy', '.gradle': 'groovy',
    '.c': 'c', '.h': 'c',
    '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp', '.c++': 'cpp',
    '.hpp': 'cpp', '.hh': 'cpp', '.hxx': 'cpp', '.h++': 'cpp',
    '.cs': 'unity-csharp', '.csx': 'csharp', '.vb': 'vbnet', '.vbs': 'vbscript',
    '.fs': 'fsharp', '.fsx': 'fsharp',
    '.go': 'go', '.rs': 'rust', '.zig': 'zig', '.nim': 'nim', '.d': 'd', '.carbon': 'carbon',
    '.swift': 'swift', '.dart': 'dart', '.m': 'objectivec', '.mm': 'objectivec',
    '.php': 'php', '.phtml': 'php', '.php3': 'php', '.php4': 'php', '.php5': 'php',
    '.php7': 'php', '.php8': 'php',
    '.rb': 'ruby', '.rbw': 'ruby', '.rake': 'ruby', '.gemspec': 'ruby', '.erb': 'ruby',
    '.pl': 'prolog', '.pm': 'perl', '.perl': 'perl', '.py3': 'python', '.pyw3': 'python',
    '.hs': 'haskell', '.lhs': 'haskell', '.ml': 'ocaml', '.mli': 'ocaml', '.elm': 'elm',
    '.ex': 'elixir', '.exs': 'elixir', '.erl': 'erlang', '.hrl': 'erlang',
    '.lisp': 'lisp', '.lsp': 'lisp', '.scheme': 'scheme', '.scm': 'scheme',
    '.r': 'r', '.rmd': 'rmarkdown', '.lua': 'lua', '.tcl': 'tcl', '.jl': 'julia',
    '.cr': 'crystal', '.odin': 'odin',
    '.sh': 'bash', '.bash': 'bash', '.zsh': 'zsh', '.fish': 'fish',
    '.csh': 'csh', '.tcsh': 'tcsh', '.ksh': 'ksh',
    '.ps1': 'powershell', '.psm1': 'powershell', '.psd1': 'powershell',
    '.bat': 'batch', '.cmd': 'batch',
    '.sql': 'sql', '.psql': 'postgresql', '.mysql': 'mysql', '.sqlite': 'sqlite',
    '.pgsql': 'postgresql', '.plsql': 'plsql',
    '.html': 'html', '.htm': 'html', '.xhtml': 'html', '.xml': 'xml', '.xsl': 'xml', '.xslt': 'xml',
    '.css': 'css', '.scss': 'scss', '.sass': 'sass', '.less': 'less',
    '.vue': 'vue', '.svelte': 'svelte', '.astro': 'astro',
    '.asm': 'assembly', '.s': 'assembly', '.nasm': 'assembly', '.masm': 'assembly',
    '.f': 'fortran', '.f77': 'fortran', '.f90': 'fortran', '.f95': 'fortran',
    '.f03': 'fortran', '.f08': 'fortran', '.for': 'fortran',
    '.pas': 'pascal', '.pp': 'pascal', '.inc': 'pascal',
    '.ada': 'ada', '.adb': 'ada', '.ads': 'ada', '.cob': 'cobol', '.cbl': 'cobol', '.pro': 'prolog',
    '.sol': 'solidity', '.move': 'move', '.cairo': 'cairo', '.yul': 'yul', '.vyper': 'vyper',
    '.fe': 'fe', '.pony': 'pony', '.red': 'red', '.factor': 'factor',
    '.tf': 'terraform', '.tfvars': 'terraform', '.hcl': 'hcl', '.yaml': 'yaml', '.yml': 'yaml',
    '.toml': 'toml', '.ini': 'ini', '.cfg': 'ini', '.conf': 'ini', '.json': 'json', '.jsonc': 'json',
    '.proto': 'protobuf', '.thrift': 'thrift', '.avro': 'avro',
    '.md': 'markdown', '.markdown': 'markdown', '.rst': 'restructuredtext',
    '.tex': 'latex', '.cls': 'latex', '.sty': 'latex', '.bib': 'bibtex', '.org': 'org-mode',
    '.ipynb': 'jupyter', '.qmd': 'quarto',
    '.gd': 'gdscript', '.hlsl': 'hlsl', '.glsl': 'glsl', '.shader': 'shader',
    '.sparql': 'sparql', '.cypher': 'cypher', '.gql': 'graphql', '.graphql': 'graphql',
}

# Whole lower-case file name -> language, used when the extension is unknown.
FULL_NAMES = {
    'dockerfile': 'dockerfile', 'containerfile': 'dockerfile',
    'makefile': 'makefile', 'gnumakefile': 'makefile',
    'cmakelists.txt': 'cmake', 'cmake': 'cmake',
    'rakefile': 'ruby', 'gemfile': 'ruby', 'podfile': 'ruby',
    'vagrantfile': 'ruby', 'guardfile': 'ruby',
    'requirements.txt': 'text', 'pipfile': 'toml',
    '.gitignore': 'gitignore', '.dockerignore': 'dockerignore',
    '.env': 'env', '.env.local': 'env', '.env.example': 'env',
    'readme': 'markdown', 'license': 'text', 'changelog': 'text', 'authors': 'text',
    'procfile': 'procfile', 'buildfile': 'text',
}

# Words inside an extension-less name -> language, tried in this order.
NAME_WORDS = [
    (('config', 'conf', 'settings'), 'config'),
    (('script', 'run', 'start', 'install'), 'script'),
    (('test',), 'test'),
]

# Extension -> language of the repository scanner (default 'unknown').
REPO_EXTENSIONS = {
    '.py': 'python', '.js': 'javascript', '.ts': 'typescript', '.jsx': 'javascript',
    '.tsx': 'typescript', '.java': 'java', '.c': 'c', '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp',
    '.cs': 'csharp', '.php': 'php', '.rb': 'ruby', '.go': 'go', '.rs': 'rust', '.swift': 'swift',
    '.kt': 'kotlin', '.scala': 'scala', '.html': 'html', '.css': 'css', '.scss': 'scss',
    '.sass': 'sass', '.xml': 'xml', '.json': 'json', '.yaml': 'yaml', '.yml': 'yaml',
    '.sql': 'sql', '.sh': 'bash', '.ps1': 'powershell', '.bat': 'batch',
    '.dockerfile': 'dockerfile', '.tf': 'terraform', '.hcl': 'hcl', '.md': 'markdown',
    '.rst': 'restructuredtext', '.txt': 'text',
}

# Extension -> language of the content-aware detector.
CONTENT_EXTENSIONS = {
    '.py': 'python', '.pyx': 'python', '.pyw': 'python',
    '.js': 'javascript', '.jsx': 'javascript', '.mjs': 'javascript',
    '.ts': 'typescript', '.tsx': 'typescript',
    '.java': 'java', '.kt': 'kotlin', '.scala': 'scala', '.c': 'c', '.h': 'c',
    '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp', '.hpp': 'cpp',
    '.cs': 'csharp', '.go': 'go', '.rs': 'rust', '.swift': 'swift',
    '.php': 'php', '.rb': 'ruby', '.pl': 'perl', '.r': 'r',
    '.sh': 'bash', '.bash': 'bash', '.ps1': 'powershell',
    '.sql': 'sql', '.html': 'html', '.xml': 'xml',
}
# File names that are their own language.
CONTENT_NAMES = ['dockerfile', 'makefile', 'rakefile', 'gemfile']
# Text markers tried in order on the lower-cased first 1000 characters.
# 'using System' can never occur in lower-cased text; it is part of the expected behaviour.
CONTENT_MARKERS = [
    ('import java.', 'java'), ('public class', 'java'), ('def ', 'python'), ('import ', 'python'),
    ('function ', 'javascript'), ('const ', 'javascript'), ('#include', 'c'),
    ('using System', 'csharp'), ('package main', 'go'), ('<?php', 'php'), ('class ', 'ruby'),
]

# Extension -> (display name, colour, category) for dashboards.
DISPLAY_EXTENSIONS = {
    '.py': ('Python', '#3776ab', 'Backend'), '.pyx': ('Cython', '#3776ab', 'Backend'),
    '.js': ('JavaScript', '#f7df1e', 'Frontend'), '.jsx': ('React', '#61dafb', 'Frontend'),
    '.ts': ('TypeScript', '#007acc', 'Frontend'),
    '.tsx': ('TypeScript React', '#007acc', 'Frontend'),
    '.mjs': ('JavaScript Module', '#f7df1e', 'Frontend'),
    '.java': ('Java', '#ed8b00', 'Backend'), '.kt': ('Kotlin', '#7f52ff', 'Backend'),
    '.scala': ('Scala', '#dc322f', 'Backend'), '.clj': ('Clojure', '#5881d8', 'Functional'),
    '.groovy': ('Groovy', '#e69f56', 'Backend'), '.c': ('C', '#a8b9cc', 'Systems'),
    '.cpp': ('C++', '#00599c', 'Systems'), '.cc': ('C++', '#00599c', 'Systems'),
    '.cxx': ('C++', '#00599c', 'Systems'), '.go': ('Go', '#00add8', 'Backend'),
    '.rs': ('Rust', '#dea584', 'Systems'), '.zig': ('Zig', '#ec915c', 'Systems'),
    '.nim': ('Nim', '#ffe953', 'Systems'), '.d': ('D', '#ba595e', 'Systems'),
    '.cs': ('C#', '#239120', 'Backend'), '.vb': ('Visual Basic', '#945db7', 'Backend'),
    '.fs': ('F#', '#378bba', 'Functional'), '.php': ('PHP', '#777bb4', 'Backend'),
    '.rb': ('Ruby', '#cc342d', 'Backend'), '.rake': ('Ruby Rake', '#cc342d', 'Backend'),
    '.erb': ('ERB Template', '#cc342d', 'Template'), '.swift': ('Swift', '#fa7343', 'Mobile'),
    '.dart': ('Dart', '#0175c2', 'Mobile'), '.hs': ('Haskell', '#5e5086', 'Functional'),
    '.ml': ('OCaml', '#3be133', 'Functional'), '.elm': ('Elm', '#60b5cc', 'Frontend'),
    '.ex': ('Elixir', '#6e4a7e', 'Backend'), '.erl': ('Erlang', '#b83998', 'Backend'),
    '.sol': ('Solidity', '#363636', 'Blockchain'),
}
# Whole names with their own display entry, and the default entry.
DISPLAY_NAMES = {
    'dockerfile': ('Dockerfile', '#384d54', 'DevOps'),
    'containerfile': ('Dockerfile', '#384d54', 'DevOps'),
    'makefile': ('Makefile', '#427819', 'Build'),
}
DISPLAY_DEFAULT = ('Code', '#6c757d', 'Other')
