"""Plan-level helpers: size-checked broadcasts, exact ranks without hot tasks, shared work folders."""
