"""Operators for preparing training text at scale.

Nothing outside this folder imports it; the registry file at the repository
top adds its queries when the folder is present.
"""
