"""Column functions: paths, module names, commands, URLs, content types, package metadata. Nearly all are built from Spark's own expressions."""

from .content import content_tier, file_arguments, io_summary, is_binary_text, security_hits, shown_content, text_type
from .metadata import cache_key, declaration_path, declared_evidence, flag, known, last_page, lock_offset, owner_repo, plain_text, recent_release, repo_url, trust_rule
from .paths import (
    base_package,
    cleaned_paths,
    extension,
    file_candidates,
    is_bare_command,
    is_bare_specifier,
    is_core_module,
    is_instance_method,
    is_third_party,
    kind_of_path,
    main_candidates,
    module_root,
    normal_path,
    package_root,
    path_is_under,
    resolved_path,
    root_ancestors,
    root_depth,
    root_package,
    safe_entry_name,
)
from .text import call_end, end_position, eval_preview, node_ids, one_line, script_targets, status_of, url_fields, whole_numbers

__all__ = [
    "base_package", "cache_key", "call_end", "cleaned_paths", "content_tier", "declaration_path", "declared_evidence", "end_position", "eval_preview", "extension", "file_arguments", "file_candidates",
    "flag", "io_summary", "is_bare_command", "is_bare_specifier", "is_binary_text", "is_core_module", "is_instance_method", "is_third_party", "kind_of_path", "known", "last_page", "lock_offset",
    "main_candidates", "module_root", "node_ids", "normal_path", "one_line", "owner_repo", "package_root", "path_is_under", "plain_text", "recent_release", "repo_url", "resolved_path", "root_ancestors",
    "root_depth", "root_package", "safe_entry_name", "script_targets", "security_hits", "shown_content", "status_of", "text_type", "trust_rule", "url_fields", "whole_numbers",
]
