"""Column functions: JVM-side expressions, and Arrow functions only where no built-in exists."""
