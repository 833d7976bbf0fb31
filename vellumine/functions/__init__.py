"""Part of vellumine; see the README."""
