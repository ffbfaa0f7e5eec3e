"""File and directory names that are skipped, and size limits."""

MIB = 1024 * 1024

# Directory names never descended into (variant "upload").
IGNORED_DIRS = [
    '.git', '__pycache__', 'node_modules', '.vscode', '.idea', 'venv', 'env', 'build', 'dist',
    'target', '.pytest_cache', '.mypy_cache', 'vendor', 'third_party', 'external', 'packages',
    'bower_components', 'jspm_packages', '.cargo', 'pods',
]
# Further directory names of the "repository" variant.
IGNORED_DIRS_REPO = IGNORED_DIRS + ['.next', '.nuget', 'coverage', '.nyc_output', 'logs']

# Hidden file names that are kept.
VISIBLE_DOTFILES = ['.env', '.htaccess', '.gitignore', '.dockerignore']
VISIBLE_DOTFILES_REPO = VISIBLE_DOTFILES + [
    '.eslintrc', '.prettierrc', '.babelrc', '.editorconfig', '.env.example']

# Name suffixes and parts that mark a file as not worth scanning.
TEMP_SUFFIXES = ['.bak', '.tmp', '.temp', '.swp', '~', '.log']
TEMP_SUFFIXES_REPO = TEMP_SUFFIXES + ['.lock']
GENERATED_PARTS = ['package-lock.json', 'yarn.lock', '.min.', '.bundle.']
ICON_PARTS = ['favicon', 'android-chrome', 'apple-touch-icon']

# Extension groups.
NATIVE_EXT = ['.exe', '.dll', '.so', '.dylib', '.bin', '.obj', '.o', '.a', '.lib']
IMAGE_EXT = ['.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.ico']
MEDIA_EXT = ['.mp3', '.mp4', '.avi', '.mov', '.wmv', '.flv', '.wav', '.ogg']
OFFICE_EXT = ['.pdf', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx']
ARCHIVE_EXT = ['.zip', '.rar', '.7z', '.tar', '.gz', '.bz2']
FONT_EXT = ['.ttf', '.otf', '.woff', '.woff2', '.eot']

BINARY_EXT = NATIVE_EXT + IMAGE_EXT + ['.svg'] + MEDIA_EXT + OFFICE_EXT + ARCHIVE_EXT
UPLOAD_BINARY_EXT = NATIVE_EXT + IMAGE_EXT + MEDIA_EXT + OFFICE_EXT
REPO_IMAGE_EXT = IMAGE_EXT + ['.svg', '.webp']
REPO_BINARY_EXT = NATIVE_EXT + OFFICE_EXT + ARCHIVE_EXT

# Limits.
MAX_FILE = 20 * MIB
MAX_TREE = 200 * MIB
MAX_TREE_REPO = 500 * MIB
MAX_UPLOAD = 10 * MIB
MAX_ARCHIVE = 100 * MIB
MAX_FILES_PER_TREE = 1000
ARCHIVE_SUFFIXES = ['.zip', '.tar', '.tar.gz']

# Manifests and the directories skipped while looking for them.
MANIFESTS = ['requirements.txt', 'poetry.lock', 'Pipfile.lock', 'package.json',
             'package-lock.json', 'Cargo.toml', 'go.mod']
MANIFEST_IGNORED_DIRS = ['.git', 'node_modules', 'venv', 'env', '__pycache__', 'target', 'build',
                         'dist']

# Supported repository hosts.
REPO_HOSTS = ['github.com', 'gitlab.com', 'bitbucket.org']
