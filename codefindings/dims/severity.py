"""Severity names, ranks, weights, colours and the CASE ladders' thresholds."""

# Severities from worst to mildest; the report rank is the list position.
SEVERITIES = ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']
UNKNOWN_RANK = 5

# Score weights (anything else weighs 1 in RISK, 0 in REPORT and DASHBOARD).
RISK_WEIGHTS = {'CRITICAL': 10, 'HIGH': 5, 'MEDIUM': 2, 'LOW': 1}
REPORT_WEIGHTS = {'CRITICAL': 25, 'HIGH': 15, 'MEDIUM': 8, 'LOW': 3}
DASHBOARD_WEIGHTS = {'CRITICAL': 40, 'HIGH': 20, 'MEDIUM': 8, 'LOW': 2}

# Risk ladders; the first rung whose condition on c, h, m, l holds gives the level.
LADDERS = {
    'codebase': [('c > 0', 'CRITICAL'), ('h >= 2', 'HIGH'), ('h = 1 AND m >= 3', 'HIGH'),
                 ('h = 1', 'MEDIUM'), ('m >= 5', 'MEDIUM'), ('m >= 2', 'LOW'),
                 ('m = 1 AND l >= 3', 'LOW')],
    'repository': [('c > 0', 'CRITICAL'), ('h >= 5', 'HIGH'), ('h >= 2', 'MEDIUM'),
                   ('h = 1 AND m >= 5', 'MEDIUM'), ('h = 1', 'LOW'), ('m >= 10', 'LOW')],
    'ui_summary': [('c > 0', 'CRITICAL'), ('h >= 2', 'HIGH'), ('h = 1 AND m >= 3', 'HIGH'),
                   ('h = 1', 'MEDIUM'), ('m >= 5', 'MEDIUM'), ('m >= 2', 'LOW')],
    'ui_badge': [('c >= 1', 'CRITICAL'), ('h >= 2', 'HIGH'), ('h = 1 AND m >= 3', 'HIGH'),
                 ('m >= 5', 'MEDIUM'), ('m >= 2', 'LOW')],
}
LOWEST_LEVEL = 'MINIMAL'

# Report score -> (level, colour); the last entry is the default.
REPORT_LEVELS = [(80, 'CRITICAL', '#dc3545'), (60, 'HIGH', '#fd7e14'), (30, 'MEDIUM', '#ffc107'),
                 (10, 'LOW', '#28a745'), (0, 'MINIMAL', '#6c757d')]
REPORT_LEVEL_TEXT = {
    'CRITICAL': 'Act on this now', 'HIGH': 'Fix with high priority',
    'MEDIUM': 'Some concerns to plan for', 'LOW': 'Small issues only', 'MINIMAL': 'In good shape',
}

# Colour palettes and icons.
UI_COLOURS = {'CRITICAL': '#FF3B30', 'HIGH': '#FF9500', 'MEDIUM': '#FFD60A', 'LOW': '#5AC8FA',
              'INFO': '#8E8E93'}
ALERT_COLOURS = {'CRITICAL': '#dc3545', 'HIGH': '#fd7e14', 'MEDIUM': '#ffc107', 'LOW': '#28a745'}
DEFAULT_COLOUR = '#6c757d'
HEAT_COLOURS = [(3, '#FF3B30'), (2, '#FF9500'), (1, '#FFD60A')]
HEAT_SAFE = '#34C759'
TYPE_ICONS = {
    'SQL_INJECTION': '💉', 'XSS': '🕷️', 'CSRF': '🔄', 'HARDCODED_SECRETS': '🔑',
    'WEAK_CRYPTO': '🔐', 'COMMAND_INJECTION': '⚡', 'BUFFER_OVERFLOW': '💥',
    'RACE_CONDITION': '🏃‍♂️', 'PATH_TRAVERSAL': '📁', 'INSECURE_DESERIALIZATION': '📦',
    'USE_AFTER_FREE': '🧠', 'NULL_POINTER_DEREFERENCE': '📍', 'MEMORY_LEAK': '🕳️',
    'INTEGER_OVERFLOW': '🔢', 'FORMAT_STRING': '📝',
}
DEFAULT_ICON = '⚠️'

# Advisory score thresholds.
CVSS_BUCKETS = [(9.0, 'CRITICAL'), (7.0, 'HIGH'), (4.0, 'MEDIUM')]
CVSS_TYPES = ['CVSS_V3', 'CVSS_V2']
